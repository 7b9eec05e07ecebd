"""A fetcher of pages that tests hand to the connectors."""

from urllib.error import HTTPError


def page(url: str) -> tuple[int, str, str]:
    if "localhost" in url:
        raise AssertionError("an unsafe link was asked for")
    if url.endswith("gone"):
        raise HTTPError(url, 404, "gone", None, None)
    if url.endswith("slow"):
        raise TimeoutError
    return 200, url + "/final", "<p>page</p>"
