"""Fetchers that tests hand to the connectors."""

from tidemark.sources.connectors import Permanent


def fetch(url: str) -> str:
    if "/revision/" in url:
        if "broken" in url:
            raise Permanent("HTTP 404")
        return "abcdef1234567"
    if url.endswith("missing.md"):
        raise Permanent("HTTP 404")
    return f"body of {url}"


def pages(link: str):
    n = int(link)
    return [n * 10 + i for i in range(3)], str(n + 1) if n < 2 else None
