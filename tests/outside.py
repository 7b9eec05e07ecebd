"""Outside effects that tests hand to the sinks: each call is a line of a file, as they run in other processes."""

import json
import os

def _log(kind: str, **what) -> None:
    with open(_folder() + "/calls.jsonl", "a") as f:
        f.write(json.dumps({"kind": kind, **what}) + "\n")


def _folder() -> str:
    with open("/tmp/tidemark-test-folder") as f:
        return f.read()


def use(folder) -> None:
    with open("/tmp/tidemark-test-folder", "w") as f:
        f.write(str(folder))


def calls(kind: str) -> list[dict]:
    path = _folder() + "/calls.jsonl"
    if not os.path.exists(path):
        return []
    with open(path) as f:
        return [x for x in map(json.loads, f) if x["kind"] == kind]


def create(row: dict) -> int:
    _log("create", batch_id=row["batch_id"])
    if row["batch_id"] == "down" and len([c for c in calls("create") if c["batch_id"] == "down"]) == 1:
        raise OSError("no answer")
    return 100 + len(calls("create"))


def find(row: dict) -> int | None:
    return 55 if row["batch_id"] == "there" else None


def label(row: dict) -> None:
    _log("label", key=row["key"])
    raise OSError("labels are off")


def patch(row: dict) -> None:
    _log("patch", number=row["number"], body=row["body"])
    if row["number"] == 13 and len([c for c in calls("patch") if c["number"] == 13]) == 1:
        raise OSError("no answer")


def page(url: str) -> tuple[int, str, str]:
    _log("page", url=url)
    if "broken" in url:
        raise TimeoutError
    return 200, url, "<form><label>Why us? <textarea name=why></textarea></label></form>"
