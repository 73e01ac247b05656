import zlib
from collections import Counter

import numpy as np

from cairn.llm import sharding


def one_jump(key: int, shards: int) -> int:
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump_is_the_published_function():
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 400)
    for shards in (1, 2, 16, 17, 1000):
        assert sharding.jump(keys, shards).tolist() == [one_jump(int(k) % 2**64, shards) for k in keys]


def test_one_more_shard_takes_rows_only_into_itself():
    keys = np.arange(20_000) * 7919
    old, new = sharding.jump(keys, 16), sharding.jump(keys, 17)
    moved = old != new
    assert set(new[moved]) == {16} and abs(moved.mean() - 1 / 17) < 0.01
    assert np.bincount(old).std() / np.bincount(old).mean() < 0.05


def check(rows, texts):
    slots = Counter()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts
    )
    for r in rows:
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 16) and 0 <= r["shard"] < 16
        slots[r["shard"], r["slot"]] += 1
    for shard in {s for s, _ in slots}:
        own = sorted(slot for s, slot in slots if s == shard)
        assert own == list(range(len(own)))
    assert set(slots.values()) <= {1}
    assert len({(r["doc_id"], r["shard"]) for r in rows}) == len({r["doc_id"] for r in rows})


def test_manifest_of_odd_and_given_documents(odd, clashing, docs):
    for df in (odd, clashing.drop("shard"), docs):
        check(sharding.manifest(df, 16).collect(), [(r["doc_id"], r["text"]) for r in df.collect()])


def test_empty_table(none):
    assert sharding.manifest(none, 16).count() == 0


def test_files_hold_all_rows(spark, docs, tmp_path):
    sharding.write(docs, str(tmp_path / "out"), ["doc_id"], 4, files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and {r[0] for r in back.select("shard").distinct().collect()} <= set(range(4))
