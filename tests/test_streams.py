"""Streams over several micro-batches, with restarts: states that end, uploads that replace."""

import pytest
from pyspark.sql import functions as F

from tidewell.streaming import ingest, jobs

MESSAGE = "session_id long, tenant_id long, seq long, role string, content string, created_at timestamp"


class Feed:
    """A folder of files, and a stream over it with one checkpoint; each ``run`` is a restart."""

    def __init__(self, spark, home, schema, job):
        self.spark, self.home, self.schema, self.job = spark, str(home), schema, job

    def run(self, *batches):
        for rows in batches:
            own = self.spark.createDataFrame(rows, self.schema.replace("timestamp", "string"))
            kinds = [F.col(c).cast("timestamp") if c == "created_at" else F.col(c) for c in own.columns]
            own.select(*kinds).coalesce(1).write.mode("append").parquet(f"{self.home}/in")
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.home}/in")
        query = self.job(stream).writeStream.outputMode("append").format("parquet").option("path", f"{self.home}/out")
        query.option("checkpointLocation", f"{self.home}/state").trigger(availableNow=True).start().awaitTermination()
        return self.spark.read.parquet(f"{self.home}/out").collect()

    def held(self, name):
        return self.spark.read.format("statestore").option("path", f"{self.home}/state").option("stateVarName", name).load().count()


def test_sessions_leave_the_state(spark, tmp_path):
    feed = Feed(spark, tmp_path, MESSAGE, lambda s: jobs.session_state_stream(s, idle_s=3600, closed_s=60, watermark="1 minute"))
    rows = feed.run(
        [(1, 1, 0, "visitor", "a", "2024-01-01 00:00:00"), (2, 1, 0, "visitor", "a", "2024-01-01 00:00:10")],
        [(1, 1, 1, "ai", "b", "2024-01-01 00:00:30"), (2, 1, 1, "close", "", "2024-01-01 00:00:40")],
    )
    assert sorted((r.session_id, r.seq, r.status, r.ai, r.visitor) for r in rows) == [(1, 0, "ai", 0, 1), (1, 1, "ai", 1, 1), (2, 0, "ai", 0, 1), (2, 1, "closed", 0, 1)]
    assert feed.held("state") == 2
    rows = feed.run([(1, 1, 2, "visitor", "c", "2024-01-01 00:10:00")])  # a restart; the closed session's hour has come
    assert [(r.ai, r.visitor) for r in rows if (r.session_id, r.seq) == (1, 2)] == [(1, 2)] and feed.held("state") == 1
    rows = feed.run([(3, 1, 0, "visitor", "d", "2024-01-01 05:00:00")])  # the first session is idle since long
    assert feed.held("state") == 1
    rows = feed.run([(1, 1, 3, "visitor", "e", "2024-01-01 05:00:10")])
    assert [(r.ai, r.visitor) for r in rows if (r.session_id, r.seq) == (1, 3)] == [(0, 1)]


def test_answered_sessions_have_no_state(spark, tmp_path):
    feed = Feed(spark, tmp_path, MESSAGE, lambda s: jobs.response_time_stream(s, idle_s=600, watermark="1 minute"))
    rows = feed.run([(1, 5, 0, "visitor", "a", "2024-01-01 00:00:00"), (2, 5, 0, "visitor", "a", "2024-01-01 00:00:00")], [(1, 5, 1, "agent", "b", "2024-01-01 00:01:10"), (1, 5, 2, "ai", "c", "2024-01-01 00:01:20")])
    assert [tuple(r) for r in rows] == [(5, 1, 70)] and feed.held("asked") == 1
    feed.run([(9, 5, 0, "ai", "x", "2024-01-01 03:00:00")])
    assert feed.held("asked") == 0  # never answered, given up


def test_rate_limit_over_batches(spark, tmp_path):
    feed = Feed(spark, tmp_path, "tenant_id long, usage_id long, created_at timestamp", lambda s: jobs.rate_limit_stream(s, 2, 60.0, watermark="1 second"))
    rows = feed.run([(1, 1, "2024-01-01 00:00:00"), (1, 2, "2024-01-01 00:00:10"), (2, 9, "2024-01-01 00:00:10")], [(1, 3, "2024-01-01 00:00:30")])
    rows = feed.run([(1, 4, "2024-01-01 00:01:05"), (1, 5, "2024-01-01 00:01:06"), (1, 6, "2024-01-01 00:01:10.5")])
    assert sorted((r.usage_id, r.accepted) for r in rows) == [(1, True), (2, True), (3, False), (4, True), (5, False), (6, True), (9, True)]
    feed.run([(2, 10, "2024-01-01 09:00:00")])
    assert feed.held("held") == 1  # the first tenant's window is over


REPLY = "session_id long, seq long, content string, images array<string>, created_at timestamp"
SPAN = "session_id long, status string, from_at timestamp, to_at timestamp"


def test_replies_by_status_with_images(spark, tmp_path):
    """A stream over four restarts equals the job on tables: groups cross batches, a person's turn stands alone."""
    day, home = "2024-01-01 ", str(tmp_path)
    spans = [(1, "ai", day + "00:00:00", day + "00:01:00"), (1, "human", day + "00:01:00", day + "02:00:00"), (9, "ai", "2024-02-01 00:00:00", "2024-02-01 00:01:00")]
    rows = [
        [(1, 0, "a", ["x1", "x2"], day + "00:00:10"), (2, 0, "e", None, day + "00:00:10")],
        [(1, 1, "b", ["x3", "x4"], day + "00:00:15"), (2, 1, "f", ["y"], day + "00:00:12"), (1, 2, "z", None, day + "00:00:58")],
        [(1, 3, "c", ["x5"], day + "00:01:05"), (1, 4, "d", None, day + "00:01:07")],
        [(9, 0, "end", None, "2024-02-01 00:00:10")],
    ]

    def table(rows, schema):
        own = spark.createDataFrame(rows, schema.replace("timestamp", "string"))
        return own.select(*[F.col(c).cast("timestamp") if c.endswith("_at") else F.col(c) for c in own.columns])

    def shown(df):
        return sorted((r.session_id, str(r.first_at)[11:], r.n, r.content, tuple(r.images)) for r in df.collect() if r.session_id < 9)

    for number, batch in enumerate(rows):
        table(batch, REPLY).coalesce(1).write.mode("append").parquet(f"{home}/m")
        table([spans[2]] if number == 3 else spans[:2] if number == 0 else [], SPAN).coalesce(1).write.mode("append").parquet(f"{home}/s")
        stream = jobs.debounce_replies(spark.readStream.schema(REPLY).parquet(f"{home}/m"), spark.readStream.schema(SPAN).parquet(f"{home}/s"), watermark="1 minute")
        query = stream.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    want = [(1, "00:00:10", 2, "a\nb", ("x1", "x2", "x3")), (1, "00:00:58", 1, "z", ()), (1, "00:01:05", 1, "c", ("x5",)), (1, "00:01:07", 1, "d", ()), (2, "00:00:10", 2, "e\nf", ("y",))]
    assert shown(spark.read.parquet(f"{home}/out")) == want
    assert shown(jobs.debounce_replies(table(sum(rows, []), REPLY), table(spans, SPAN))) == want


UPLOAD = "doc_id long, tenant_id long, kb_id string, filename string, text string"


@pytest.fixture()
def uploads(spark, tmp_path):
    def put(rows):
        spark.createDataFrame(rows, UPLOAD).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(UPLOAD).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        ingest.ingest_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"))
        return str(tmp_path / "out")

    return put


def shown(spark, path, table, *columns):
    return sorted(tuple(r) for r in ingest.ingested(spark, path, table).select(*columns).collect())


def test_uploads_replace_each_other(spark, uploads):
    records = "\n\n".join(f"【桥】M{k}：重量: {k}KG；距离: {k}KM" for k in range(5))
    path = uploads([(1, 1, "k", "a.txt", "one\n\ntwo"), (2, 2, "k", "a.txt", "theirs"), (3, 1, "k", "none.txt", None), (4, 1, "k", "r.xlsx", records)])
    heads = [t[:6] for _, _, t in shown(spark, path, "chunks", "filename", "seq", "text") if _ == "r.xlsx" or t.startswith("【")]
    assert "【文档概览】" in heads and "【条目速览】" in heads and "【属性对照】" in heads
    assert ("none.txt", "failed", "no text") in shown(spark, path, "status", "filename", "status", F.coalesce("reason", F.lit("")))
    theirs = shown(spark, path, "chunks", "tenant_id", "text")[-1]
    path = uploads([(5, 1, "k", "a.txt", "new text"), (6, 1, "k", "none.txt", "now it has")])
    texts = shown(spark, path, "chunks", "tenant_id", "filename", "doc_id", "text")
    assert [t for t in texts if t[1] == "a.txt"] == [(1, "a.txt", 5, "new text"), (2, "a.txt", 2, "theirs")] and theirs == (2, "theirs")
    assert [s for s in shown(spark, path, "status", "filename", "doc_id", "status") if s[0] == "none.txt"] == [("none.txt", 6, "success")]
    assert {r[0] for r in shown(spark, path, "vectors", "chunk_id")} == {r[0] for r in shown(spark, path, "chunks", "chunk_id")}


def test_a_batch_that_comes_again(spark, tmp_path):
    path = str(tmp_path / "out")
    first = spark.createDataFrame([(1, 1, "k", "a.txt", "one"), (2, 2, "k", "b.txt", "other")], UPLOAD)
    second = spark.createDataFrame([(3, 1, "k", "a.txt", "two"), (4, 1, "k", "c.txt", "three"), (9, 1, "k", "c.txt", "four")], UPLOAD)
    for number, rows in ((0, first), (1, second), (1, second), (1, second)):
        ingest.ingest_batch(rows, number, path)
    want = [(1, "four"), (1, "two"), (2, "other")]
    assert shown(spark, path, "chunks", "tenant_id", "text") == want
    ingest.ingest_batch(spark.createDataFrame([(10, 2, "k", "b.txt", "other again")], UPLOAD), 2, path)
    assert ingest.drop_replaced(spark, path) == 1
    assert shown(spark, path, "chunks", "tenant_id", "text") == [(1, "four"), (1, "two"), (2, "other again")]
