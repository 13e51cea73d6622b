"""Operators hand on contents, not digests alone."""

from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from tidewell.llm import packing, sharding


def test_packed_pieces_hold_their_ids(spark, odd, odd_rows):
    encode = packing.Encoder(*packing._default_tokenizer()).ids
    want = Counter()
    for i, t in odd_rows:
        ids = np.append(encode(t or ""), 0).tolist()
        want.update((i, a, tuple(ids[a : a + 1024])) for a in range(0, len(ids), 1024))
    packed = packing.pack_documents(odd).cache()
    rows = packed.collect()
    assert Counter((r.doc_id, r.start, tuple(r.ids)) for r in rows) == want
    parts = defaultdict(dict)
    for r in rows:
        parts[r.sequence_id][r.offset] = r.ids
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert whole == {k: [x for o in sorted(p) for x in p[o]] for k, p in parts.items()}
    last = dict(corpus_pipeline.STAGES)["packing"](spark, odd, "")
    assert Counter((r.doc_id, r.start, tuple(r.ids)) for r in last.collect()) == want


def test_shards_hold_whole_records(spark, odd_wide, tmp_path):
    key = lambda row: repr(tuple(row))
    placed = sharding.shard_documents(odd_wide, 3)
    assert placed.schema["record"].dataType.names == odd_wide.columns
    want = Counter(map(key, odd_wide.collect()))
    assert Counter(key(r.record) for r in placed.collect()) == want
    sharding.write_shards(placed, str(tmp_path / "shards"))
    rows = spark.read.parquet(str(tmp_path / "shards")).collect()
    assert Counter(key(r.record) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
