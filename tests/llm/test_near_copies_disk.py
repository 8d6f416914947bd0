"""Near copies: the paths that find them, and the tables with prefixes that they leave none of."""

from __future__ import annotations

from pathlib import Path

from loomstone.llm import common, near_copies, simhash


def test_tables_with_prefixes_are_deleted_once_they_are_used(spark):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(words[: 59 + i % 2])) for i in range(6)] + [(9, None)], "doc_id long, text string")
    folder = Path(common.scratch_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    found = near_copies.near_duplicates(docs).collect()
    assert sorted(r["doc_id"] for r in found if r["representative"]) == [0, 9]
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
    assert "near-keys" in left and not left & {"near-sketch", "near-distinct"}


def test_simhash_links_near_copies_and_wider_fingerprints_the_rest(spark, monkeypatch):
    """Each path finds near copies where the other is shut off."""
    def none(batches):
        return iter(())

    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[i : 190 + i]) for i in range(4)] + [" ".join(f"v{i}" for i in range(50))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bits = [simhash.majority(near_copies.shingles(t.encode())) for t in texts]
    assert all((bits[0] ^ b).bit_count() <= near_copies.RADIUS for b in bits[:4])

    def kept():
        return sorted(r["doc_id"] for r in near_copies.near_duplicates(docs).collect() if r["representative"])

    monkeypatch.setattr(near_copies, "TILE", 2)
    with monkeypatch.context() as rest_off:
        rest_off.setattr(near_copies, "_candidates", lambda low, high: none)
        assert kept() == [0, 4]
    with monkeypatch.context() as simhash_off:
        simhash_off.setattr(near_copies, "_simhash_links", none)
        assert kept() == [0, 4]
