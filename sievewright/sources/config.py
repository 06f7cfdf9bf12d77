"""Settings of a workspace."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from urllib.parse import urlparse


@dataclass(frozen=True)
class Config:
    """Where things lie and what is allowed. The language ``any`` or ``*`` allows all."""

    root: str
    mailbox_root: str = ""
    languages: tuple[str, ...] = ("en", "de", "fr", "it", "es", "ru")
    inline_bytes: int = 5 << 20
    doc_link: str = ""
    server: str = ""
    transport: str = "tls"
    #: Remembered verdicts on texts; empty for none.
    verdicts: str = "verdicts.jsonl"
    screeners: tuple[str, ...] = field(default=("heuristic", "script"))

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, prefix: str = "SIEVEWRIGHT_") -> Config:
        """From environment variables; raises on a cap that is not positive, and on a plain-text server that isn't this machine."""
        e = os.environ if env is None else env
        get = lambda n, d="": e.get(prefix + n, d) or d
        cap = int(get("INLINE_MB", "5"))
        if cap <= 0:
            raise ValueError("INLINE_MB must be positive")
        server = get("SERVER")
        kinds = {"imaps": "tls", "imap+starttls": "starttls", "imap": "plain", "": "tls"}
        url = urlparse(server)
        if url.scheme not in kinds:
            raise ValueError(f"unknown kind of server {url.scheme!r}")
        if kinds[url.scheme] == "plain" and url.hostname not in ("localhost", "127.0.0.1", "::1"):
            raise ValueError("plain text is only allowed to this machine")
        root = get("ROOT", os.path.expanduser("~/sievewright"))
        languages = tuple(x.strip() for x in get("LANGUAGES", "en,de,fr,it,es,ru").split(",") if x.strip())
        return cls(root=root, mailbox_root=get("MAILBOX_ROOT", os.path.join(root, "mail")), languages=languages, inline_bytes=cap << 20, doc_link=get("DOC_LINK"), server=server, transport=kinds[url.scheme])

    def address(self) -> str:
        """Host and port of the server, with the usual port of its transport."""
        u = urlparse(self.server)
        return f"{u.hostname}:{u.port or (993 if self.transport == 'tls' else 143)}"
