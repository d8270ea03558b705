"""A task sends postings on in the order in which they are stored, so that what sorts them has only to merge."""

import zlib

import pyarrow as pa

from memspan.operators import textindex as T


def test_postings_come_in_stored_order(monkeypatch):
    texts = ["one two three two", "Élan vital, m7 x", None, "", "two m7 Élan one", "three-four one"]
    batch = pa.RecordBatch.from_arrays([pa.array([4, 9, 2, 7, 1, 5]), pa.array([2, 0, 1, 0, 0, 1], pa.int32()), pa.array(texts)], names=["id", "block", "_0"])
    found = [tuple(r.values()) for b in T._post(["t"])(iter([batch])) for r in b.to_pylist()]
    assert found == sorted(found, key=lambda r: (zlib.crc32(r[1].encode()) % T.BUCKETS, r[1], r[3], r[2]))
    told = {(i, term): (n, len(T.terms(t))) for i, t in zip(batch.column(0).to_pylist(), texts) if t for term, n in T.term_counts(t).items()}
    assert {(r[2], r[1]): r[4:] for r in found} == told
    assert all(T.term_counts(t) == {x: T.terms(t).count(x) for x in T.terms(t)} for t in texts if t)
    monkeypatch.setattr(T, "KNOWN_WORDS", 1)
    assert [tuple(r.values()) for b in T._post(["t"])(iter([batch])) for r in b.to_pylist()] == found
