"""Cleaning, language, toxicity and chat formatting."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from buildlens.llm import chat, language, quality, toxicity
from buildlens.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import differences, duck
from tests.llm.conftest import LONG, ODD, prose


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_against_sql(spark, folder, name):
    assert differences(QUERIES[name](spark, folder), duck(folder), ORACLE_SQL[name]) == []


def slow_measures(text):
    words = re.findall("[^\\x20\\x09-\\x0D]+", text or "")
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    counts = {}
    for g in grams:
        counts[g] = counts.get(g, 0) + 1
    covered = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\\x20\\x09-\\x0D]", x)]
    base = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(covered), base)


def test_cleaning_of_odd_rows(odd, empty):
    got = quality.clean_lines(odd).select(
        "input.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(i, *slow_measures(t)) for i, t in ODD], key=str)
    assert quality.clean_lines(empty).count() == 0
    whole = quality.cleaned(odd)
    assert whole.schema.names == odd.schema.names and quality.cleaned(empty).count() == 0


def test_failing_lines_go_and_heavy_losers_with_them(spark):
    good = "This is a line of good prose that ends as it should."
    menu = "home | news | sport | about"
    more = "Another sentence follows here, and it says something else again."
    rows = [(1, f"{good}\n{menu}\n{more}"), (2, f"{menu} | {menu} | {menu}\n{good[:40]}"),
            (3, f"{good}\nAll rights reserved.\n\n{more}"), (4, f"{good} {' '.join('ab#%$ cd&&'.split() * 3)}"),
            (5, " ".join(f"w{i}" for i in range(40)))]
    got = {r["input"]["doc_id"]: r for r in quality.clean_lines(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and menu not in got[1].clean_text and good in got[1].clean_text
    assert not got[2].kept
    assert got[3].kept and got[3].clean_text == f"{good}\n\n{more}"
    assert not got[4].kept and not got[5].kept
    left = quality.cleaned(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in left) == [1, 3]


def test_language_by_compression(spark, odd, empty):
    rng = random.Random(1)
    syllables = {"xx": ["ka", "lo", "mi"], "yy": ["stra", "fen", "gurt"]}

    def text(lang, n=40):
        return " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(n))

    rows = [(i, text("xx" if i % 2 else "yy"), "xx" if i % 2 else "yy") for i in range(60)]
    rows += [(90, None, "xx"), (91, "123 !", "yy"), (92, text("xx"), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert sorted(model) == ["xx", "yy"] and all(
        len(m.decode()) <= language.TEXTS * (language.CHARS + 1) for m in model.values())
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert all(got[i].lang_pred == lang and 0 < got[i].score <= 1 for i, _, lang in rows[:60])
    assert got[90][1:] == ("und", 0.0, True) and got[91][1:] == ("und", 0.0, True)
    kept = {r.doc_id: r.lang for r in language.recognised(docs, model).collect()}
    assert kept == {**{i: lang for i, _, lang in rows[:60]}, 92: "xx"}
    found = language.predict(odd, model).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
    assert language.fit(empty) == {} and language.predict(empty, model).count() == 0
    assert {r.lang_pred for r in language.predict(odd, {}).collect()} == {"und"}
    assert language.predict(docs, {"xx": model["xx"]}).filter("lang_pred = 'xx'").count() == 61


def test_ties_of_languages_go_to_the_first_by_name():
    same = language.Classifier({"b": b"abc abc", "a": b"abc abc"})
    assert same.classify("abc") == ("a", 0.0)


def held_out_accuracy(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = QUERIES["op2_compression_language"](spark, folder).join(docs.select("doc_id", "lang"), "doc_id")
    return found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).head()[0]


def test_language_query(spark):
    assert held_out_accuracy(spark, "/root/testdata/sf0.01") > 0.93


def test_toxicity_query(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = QUERIES["op1_sentence_toxicity"](spark, folder)
    held = found.join(labels, "doc_id").filter("held_out").collect()
    hits = sum(r.predicted and r.toxic for r in held)
    assert hits / sum(r.toxic for r in held) > 0.7
    assert hits / sum(r.predicted for r in held) > 0.85
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in held)


def test_toxicity_finds_the_sentence(spark, odd, empty):
    rows = []
    for i in range(240):
        sentences = [prose(i * 10 + k, 9, ("the", "of", "stone", "haus", "bread")) for k in range(4)]
        if i % 3 == 0:
            sentences[i % 4] += " you grumblefool"
        rows.append((". ".join(sentences) + ".", int(i % 3 == 0)))
    w = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))
    text = "A good stone. The haus of bread grumblefool it is. The stone of haus."
    scorer = toxicity.Scorer(w)
    score, spans = scorer.score(text)
    assert score > 0.5 and [text[s["start"]:s["stop"]].strip() for s in spans] == \
        ["The haus of bread grumblefool it is"]
    assert scorer.score("The stone of haus. The bread of stone.")[0] < 0.3
    assert scorer.score(None) == (0.0, []) and scorer.score(" \n ") == (0.0, [])
    found = toxicity.score_documents(odd, w).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
    assert toxicity.score_documents(empty, w).count() == 0
    start = toxicity.fit(spark.createDataFrame([], "text string, toxic int"))
    assert start[:-1].any() == False and start[-1] == toxicity.START  # noqa: E712


def test_toxicity_sample_is_bounded_and_held_out(spark, odd):
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(12)] + [(5, 1, 0), (None, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    sample = toxicity.labelled_sample(odd, labels, 4)
    assert sample.select("doc_id").distinct().count() <= 4
    from zlib import crc32
    assert all(crc32(str(r.doc_id).encode()) % 4 != 2 for r in sample.collect())


@given(st.text(st.sampled_from("<|\\n\nim_startend>a ")))
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)
    assert chat.parse(chat.format_turn(text, text) * 2) == [(text, text)] * 2


def slow_chat(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for c, turns in by.items():
        turns = [t[2:] for t in sorted(turns)]
        told = "".join(f"{r}\n{t}\n" for r, t in turns)
        learned = "".join(t for r, t in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(learned),
                    hashlib.sha256(learned.encode()).hexdigest(),
                    sum(len(chat.format_turn(r, t)) for r, t in turns)))
    return out


CONVERSATIONS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "hi"), (1, 2, "user", "more"),
    (2, 0, "user", "hello"), (2, 1, "assistant", "hi"),
    (3, 0, "user", "hello"), (3, 1, "assistant", "no"), (3, 2, "assistant", "<|im_end|>\n<\\|im"),
    (4, 1, "assistant", "hi"), (4, 0, "user", "hello"), (5, 0, None, None), (5, 0, "user", None),
    (6, None, "system", LONG), (None, 0, "user", "x"), (7, 0, "user", "hello"), (7, 0, "user", "hello"),
    (8, 0, "a\nb<|\\", "x<|y"),
]


@pytest.mark.parametrize("size", [chat.SEQUENCE_CHARS, 1])
def test_conversations_are_read_back_from_trees(spark, size):
    df = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string") \
        .withColumn("leaf", F.lit(1)).withColumn("path", F.lit("p"))
    got = chat.chat_digests(df, size).collect()
    assert sorted(map(tuple, got), key=str) == sorted(slow_chat(CONVERSATIONS), key=str)
    assert chat.chat_digests(df.limit(0)).count() == 0
    for turns, chars in ((1, 1 << 20), (2, 1 << 20), (1000, 60)):
        got = chat.chat_digests(df, size, turns, chars).collect()
        assert sorted(map(tuple, got), key=str) == sorted(slow_chat(CONVERSATIONS), key=str)


def test_very_long_conversation_is_cut_and_shared(spark):
    rng = random.Random(3)
    turns = [(k, rng.choice(["user", "assistant"]), f"turn {k} <|im_end|> {'x' * rng.randint(0, 30)}") for k in range(7000)]
    rows = [(1, *t) for t in turns] + [(2, *t) for t in turns[:4100]] + [(3, *t) for t in turns[:2000]]
    rows += [(4, *t) for t in turns[:2001]] + [(None, *t) for t in turns[:5000]] + [(5, 0, "user", "short")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.chat_digests(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(slow_chat(rows), key=str)
    formatted = chat.format_conversations(df)
    assert formatted.agg(F.max(F.size("turns"))).head()[0] == chat.SEGMENT_TURNS
    trees = chat.build_trees(formatted).collect()
    # Shared turns stand once, and positions go on from one segment to the next.
    assert sum(len(t.nodes) for t in trees) == 7000 + 1
    size = 0
    ends = {}
    for _, role, text in turns:
        size += len(chat.format_turn(role, text))
        ends[size] = True
    assert {n.position + n.stop - n.start for t in trees for n in t.nodes} >= set(ends)


def test_shared_turns_stand_once_with_positions_and_ancestors(spark):
    df = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(df).repartition(1)
    trees = chat.build_trees(formatted).collect()
    text = "".join(t.text for t in trees)
    assert text.count("assistant\nhi<|im_end|>") == 1
    for t in trees:
        for n in t.nodes:
            # A turn attends to its ancestors and to nothing else, and counts on from them.
            assert n.position == sum(s.stop - s.start for s in n.ancestors)
            whole = "".join(t.text[s.start:s.stop] for s in n.ancestors) + t.text[n.start:n.stop]
            assert "".join(chat.format_turn(*x) for x in chat.parse(whole)) == whole
        ends = [n.start for n in t.nodes[1:]] + [len(t.text)]
        assert [n.stop for n in t.nodes] == ends


def test_language_against_a_plain_loop(spark):
    """Every document of the table, compressed by hand."""
    import zstandard as z

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = language.fit(language.learnable(docs))
    assert sorted(model) == sorted(r.lang for r in docs.select("lang").dropna().distinct().collect())
    got = {r.doc_id: (r.lang_pred, r.score) for r in QUERIES["op2_compression_language"](spark, folder).collect()}
    for doc_id, text in docs.select("doc_id", "text").collect():
        if not any(c.isalpha() for c in text or ""):
            assert got[doc_id] == ("und", 0.0)
            continue
        data = text.encode()
        sizes = []
        for lang, content in sorted(model.items()):
            own = z.ZstdCompressor(level=language.LEVEL, write_content_size=False, write_dict_id=False,
                                   dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT))
            sizes.append((sum(len(own.compress(data[i:i + language.BLOCK]))
                              for i in range(0, len(data), language.BLOCK)), lang))
        (best, lang), (second, _) = sorted(sizes)[:2]
        assert got[doc_id] == (lang, pytest.approx(1 - best / second))


def test_language_that_is_mostly_copies_is_learned(spark):
    rng = random.Random(2)
    texts = {"xx": [" ".join(rng.choices(["kalo", "milo", "loka", "kami"], k=30)) for _ in range(40)],
             "yy": [" ".join(rng.choices(["strafen", "gurten", "fengur"], k=30)) for _ in range(40)]}
    rows = [(t, "xx") for t in texts["xx"]] + [(t, "yy") for t in texts["yy"]] + [(texts["yy"][0], "yy")] * 5000
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"), texts=10)
    assert all(len(m.decode().split("\n")) == 10 for m in model.values())
    assert language.Classifier(model).classify(texts["yy"][5])[0] == "yy"


def test_toxicity_against_plain_python(spark):
    """Scores of the table by the formula, and one step of learning by finite differences."""
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    w = toxicity.fit(toxicity.labelled_sample(docs, labels)).astype(np.float32)

    def slow(text, w):
        clean = 1.0
        for sentence in re.split("[.!?\n]+", text or ""):
            if sentence.strip():
                found = {b for word in sentence.split() for b in toxicity.features(word).tolist()}
                clean *= 1 - 1 / (1 + np.exp(-(w[toxicity.BUCKETS] + sum(float(w[b]) for b in sorted(found)))))
        return 1 - clean

    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, w).collect()}
    exact = w.astype(float)
    # A word's buckets add up word by word in a score, so a bucket that two words share counts twice.
    close = [abs(got[i] - slow(t, exact)) < 0.02 for i, t in rows]
    assert np.mean(close) > 0.9 and len(got) == len(rows)

    rows = [("the stone fell. a mild day", 0), ("the grumble fool fell", 1), ("mild. grumble. day", 1)]
    start = np.zeros(toxicity.BUCKETS + 1)
    start[toxicity.BUCKETS] = -1.0

    def loss(w):
        return sum(-np.log(slow(t, w) if label else 1 - slow(t, w)) for t, label in rows) / len(rows)

    w, square = start.copy(), np.full(len(start), 1e9)
    toxicity.Bags(rows).learn(w, square, 1)
    moved = np.flatnonzero(w != start)
    for b in moved.tolist():
        up, down = start.copy(), start.copy()
        up[b] += 1e-5
        down[b] -= 1e-5
        slope = (loss(up) - loss(down)) / 2e-5
        # A step against the slope, of RATE by the root of the squares so far.
        assert (w[b] - start[b]) * np.sqrt(1e9) / toxicity.RATE == pytest.approx(-slope, rel=1e-3, abs=2e-5)
    assert len(moved) > 10


def test_toxicity_sample_has_one_row_for_an_id(spark):
    docs = spark.createDataFrame([(3, f"text {i % 7}") for i in range(500)] + [(4, "x" * (toxicity.TEACHING_CHARS + 1)), (5, None)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(3, 6)] + [(3, 0)], "doc_id long, toxic int")
    from zlib import crc32
    learned = {i for i in (3, 5) if crc32(str(i).encode()) % 4 != 2}
    got = toxicity.labelled_sample(docs, labels).collect()
    assert len(got) == len(learned) and {r.doc_id for r in got} == learned


def test_lines_in_other_scripts_need_their_own_marks(spark):
    words = {"\u0964": "\u0928\u092e\u0938\u094d\u0924\u0947", "\u061f": "\u0645\u0631\u062d\u0628\u0627",
             "\u1362": "\u1230\u120b\u121d", "\u0589": "\u0562\u0561\u0580\u0587", "": "\u0e2a\u0e27\u0e31\u0e2a\u0e14\u0e35"}
    rows = [(i, " ".join(f"{w}{k}" for k in range(40)) + mark) for i, (mark, w) in enumerate(words.items())]
    rows += [(9, " ".join(f"word{k}" for k in range(40)))]
    rows += [(10, "Une bonne phrase de dix mots qui finit bien ici toujours.\nTous droits r\u00e9serv\u00e9s")]
    got = {r["input"]["doc_id"]: (r.kept, r.clean_text) for r in quality.clean_lines(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i][0] for i in range(5)] == [True] * 5 and not got[9][0]
    assert got[10][0] and "droits" not in got[10][1]
