"""Feeds as a stream: revisions are offsets, and what moved is read once."""

from tidemark.sources import connectors


def put(folder, path, text):
    file = folder / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(text)


def test_what_moved_is_read_once(spark, tmp_path):
    spark.dataSource.register(connectors.FeedSource)
    copy = tmp_path / "copy"
    sources = "\n".join(["s1\tone\tmain\ta.md", "s2\tone\tmain\tb.md", "s3\ttwo\tmain\tc.md", "s4\tthree\tmain\td.md"])
    for repository, files in {"one": ("a.md", "b.md"), "two": ("c.md",)}.items():
        put(copy, f"{repository}/revision/main", "0000001\n")
        for f in files:
            put(copy, f"{repository}/0000001/{f}", f"{repository} {f} at 1")

    def poll():
        stream = spark.readStream.format("feeds").option("sources", sources).option("base", f"file://{copy}").option("fetcher", "tidemark.sources.connectors:folder_get").load()
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r["source_id"], r["revision"], r["body"], r["error"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    first = [("s1", "0000001", "one a.md at 1", None), ("s2", "0000001", "one b.md at 1", None), ("s3", "0000001", "two c.md at 1", None)]
    assert poll() == first  # the third repository can't be told: nothing is said of it
    assert poll() == first  # nothing moved, and the stream started again
    put(copy, "one/revision/main", "0000002")
    put(copy, "one/0000002/a.md", "one a.md at 2")  # and the other file is gone
    put(copy, "two/revision/main", "x")  # too short to be a revision
    second = [*first, ("s1", "0000002", "one a.md at 2", None), ("s2", "0000002", None, "Permanent: no such file")]
    assert poll() == sorted(second, key=lambda r: (r[0], r[1]))
    put(copy, "three/revision/main", "0000009")
    put(copy, "three/0000009/d.md", "three")
    assert ("s4", "0000009", "three", None) in poll() and len(poll()) == 6


def test_offsets_name_what_is_read():
    stream = connectors.FeedStream({"sources": "s1\tone\tmain\ta.md\ns2\ttwo\tmain\tb.md", "fetcher": "tests.feeds:fetch"})
    assert stream.initialOffset() == {}
    end = stream.latestOffset()
    assert set(end) == {"one main", "two main"}
    assert [p.name for p in stream.partitions({"one main": end["one main"]}, end)] == ["two main"]
    (part,) = stream.partitions({"one main": end["one main"], "two main": "old"}, end)
    assert [r[0] for r in stream.read(part)] == ["s2"] and part.revision == end["two main"]
    stream.commit(end)
    assert stream.committed == end
