"""Vector links against all pairs, and archives against what was written."""

import hashlib
import math

import numpy as np
import pytest

from ledgerlens.llm import embedding_dedup, warc


@pytest.mark.parametrize("block", [1000, 7])
def test_vector_links(spark, block):
    r = np.random.default_rng(1)
    centers = r.normal(size=(12, 24))
    rows = []
    for i in range(200):
        v = centers[i % 12] + r.normal(size=24) * (0.15 if i % 3 else 1.0)
        rows.append((i, v.astype(np.float32).tolist(), i % 2))
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 1), (202, None, 0), (203, [0.0] * 24, 0), (204, [math.nan] * 24, 0)]
    rows += [(205, rows[3][1], None), (206, [None] * 24, 1), (207, [1.0], 1), (208, [math.inf] * 24, 1), (200, rows[0][1], 0)]
    table = spark.createDataFrame([(*x, "note", 1) for x in rows], "vec_id long, embedding array<float>, label int, id string, weight int")
    got = embedding_dedup.linked_vectors(table, block_rows=block).collect()
    usable = [k for k, (_, v, g) in enumerate(rows) if g is not None and v is not None and len(v) == 24 and None not in v and all(map(math.isfinite, v)) and any(v)]
    unit = {k: np.array(rows[k][1], np.float64) / np.linalg.norm(np.array(rows[k][1], np.float64)) for k in usable}
    links, root = [0] * len(rows), {x[0]: x[0] for x in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in usable:
        for b in usable:
            if a != b and rows[a][2] == rows[b][2] and unit[a] @ unit[b] >= 0.93:
                links[a] += 1
                x, y = find(rows[a][0]), find(rows[b][0])
                root[max(x, y)] = min(x, y)
    want = sorted((x[0], links[k], find(x[0]), find(x[0]) == x[0]) for k, x in enumerate(rows))
    assert sorted((x["vec_id"], x["n_links"], x["component_id"], x["kept"]) for x in got) == want
    assert embedding_dedup.linked_vectors(table.limit(0)).count() == 0


def test_vectors_of_every_length_are_linked(spark):
    """Two lengths with copies and near copies, in one label and under shared ids; a length of one label only."""
    r = np.random.default_rng(2)
    rows = []
    for length, label, first in ((24, 0, 0), (40, 0, 100), (24, 1, 200), (5, 1, 300), (40, 0, 3)):
        v = r.normal(size=length)
        rows += [(first, v.tolist(), label), (first + 1, v.tolist(), label), (first + 2, (v + r.normal(size=length) * 0.01).tolist(), label)]
    rows += [(i, r.normal(size=24).tolist(), 0) for i in range(400, 420)] + [(3, rows[0][1], 0)]
    got = embedding_dedup.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    unit = [np.array(v) / np.linalg.norm(v) for _, v, _ in rows]
    near = lambda a, b: rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93
    links = [sum(a != b and near(a, b) for b in range(len(rows))) for a in range(len(rows))]
    assert sorted((x["vec_id"], x["n_links"]) for x in got) == sorted((x[0], n) for x, n in zip(rows, links))
    component = {x["vec_id"]: x["component_id"] for x in got if x["vec_id"] != 3}
    assert [component[i] for i in (2, 5, 102, 202, 302, 410)] == [0, 3, 100, 200, 300, 410]


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 32))
    assert np.allclose(np.linalg.norm(embedding_dedup.hadamard(x), axis=1), np.linalg.norm(x, axis=1))


PAGES = [(1, "http://a/é \n", "<p>ü</p>"), (2, None, "<p>ü</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "x" * 300_000)]
PAGES += [(None, "http://f", "<p>ü</p>"), (2, "http://g", "<p>ü</p>"), (6, "http://h", "only\r\n\r\nhere"), (6, "http://h", "only\r\n\r\nhere")]


def test_archived_pages(spark):
    table = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, archive string")
    got = warc.archived_pages(table).collect()
    want = []
    for page, _, html in PAGES:
        body = (html or "").encode()
        first = min(p for p, _, h in PAGES if (h or "") == (html or "") and p is not None)
        kind = "response" if page == first else "revisit"
        want.append((page, len(body), warc.digest32(body), kind, None if kind == "response" else first, None))
    key = lambda x: tuple(str(c) for c in x)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["error"]) for r in got), key=key) == sorted(want, key=key)
    assert warc.archived_pages(table.limit(0)).count() == 0


def test_archive_files_and_broken_records(spark, tmp_path):
    record = warc.record_bytes("urn:page:1", "http://a", "2024-01-01T00:00:00Z", b"payload", None)
    archive = warc.Archive(b"WARC/1.1 dictionary of common bytes", 3)
    archive.add(record)
    archive.add(record.replace(b"Content-Length: 7\r\n", b"Content-Length: 8\r\n"))
    archive.add(record.replace(b"payload\r\n", b"paYload\r\n"))
    archive.add(record.replace(b"WARC-Date: 2024-01-01T00:00:00Z\r\n", b""))
    content = b"".join(archive.parts)
    (tmp_path / "a.warc.zst").write_bytes(content)
    (tmp_path / "b.warc.zst").write_bytes(content[:-3])
    (tmp_path / "c.warc.zst").write_bytes(b"")
    rows = warc.read_archives(warc.archive_files(spark, str(tmp_path))).collect()
    whole = sorted((r for r in rows if r["archive"].endswith("a.warc.zst")), key=lambda r: r["position"])
    assert bytes(whole[0]["payload"]) == b"payload" and whole[0]["error"] is None
    assert [bool(r["error"]) for r in whole] == [False, True, True, True]
    cut = sorted((r for r in rows if r["archive"].endswith("b.warc.zst")), key=lambda r: r["position"])
    assert len(cut) == 4 and "cut" in cut[3]["error"] and cut[0]["error"] is None
    assert hashlib.sha1(b"payload").digest()


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op6_mixing", "op9_warc", "op10_substring_dedup"])
def test_query_equals_sql(spark, duck, sf_dir, name):
    from oracle import compare

    from ledgerlens.llm.queries import ORACLES, QUERIES

    assert compare(spark, duck, sf_dir, QUERIES[name], ORACLES[name])[0] == "ok"
