"""Names and addresses that belong to one build farm, not to the rules.

Every function that builds a path, an image name or a remote takes a ``Site``.
The defaults are placeholders; a farm passes its own organisation and hosts.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Site:
    org: str = "acme"
    inner_org: str = "acme-inc"
    git_host: str = "git@github.com"
    file_server: str = "http://files.acme.example"
    ci_base: str = "https://ci.acme.example"
    config_base: str = "https://raw.acme.example/devops-config"
    dockerfile_base: str = "https://raw.acme.example/ci/main/Dockerfile/release"
    registry: str = "hub.acme.example"
    new_registry: str = "hub-new.acme.example"
    mirror_registry: str = "mirror.acme.example"


DEFAULT_SITE = Site()
