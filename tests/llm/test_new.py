"""Vector codes, fill-in-middle and archives against plain Python."""

import hashlib
import math
import random
import urllib.parse
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from campaign.llm import fim, queries, vectors, warc
from campaign.llm.oracles import ORACLES
from tests import compare


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_fill_in_middle", "op13_warc_archives"])
def test_rows_equal_sql(spark, sf_dir, name):
    compare.same(queries.QUERIES[name](spark, sf_dir), compare.views(sf_dir), ORACLES[name])


# fill-in-middle


@pytest.mark.parametrize("share", [0.0001, 0.02, 0.5, 0.98, 1.0])
def test_containers_select_what_a_list_holds(share):
    rng = np.random.default_rng(int(share * 1e4))
    for size in (1, 63, 64, 65, 5000, 65536):
        mask = rng.random(size) < share
        mask[rng.integers(size)] = True
        runs = np.repeat(rng.random(size // 16 + 1) < share, 16)[:size]
        runs[-1] = True
        for m in (mask, runs, ~mask if (~mask).any() else mask):
            places, found = np.flatnonzero(m), fim.container(m)
            for k in {0, len(places) - 1, *rng.integers(len(places), size=20).tolist()}:
                assert found.select(k) == places[k]


def test_containers_are_of_three_kinds():
    few, every_second, most = np.zeros(65536, bool), np.zeros(65536, bool), np.ones(65536, bool)
    few[[5, 900, 40000]] = every_second[::2] = True
    most[7] = False
    assert [type(fim.container(m)) for m in (few, every_second, most)] == [fim.ArrayContainer, fim.BitmapContainer, fim.RunContainer]


@pytest.mark.parametrize("text", ["", "a", "é", "aé" * 70_000, "日本語 " * 40_000, "x" * 200_000, "\U0001f600ab\n" * 30_000])
def test_cuts_fall_where_code_points_do(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    found = fim.BoundarySet(raw)
    assert len(found) == len(text)
    for k in {0, 1, len(text) // 3, len(text) // 2, len(text) - 1, len(text), len(text) + 5} - {-1}:
        assert found.cut(k) == len(text[:k].encode())


@pytest.mark.parametrize("units", ["words", "lines"])
def test_words_and_lines_begin_once_in_texts_of_many_containers(units):
    text = " \n".join(f"w{k}é two" for k in range(20_000))
    raw = np.frombuffer(text.encode(), np.uint8)
    found = fim.BoundarySet(raw, fim.UNITS[units])
    starts = [k for k, c in enumerate(text) if (not c.isspace() and (not k or text[k - 1].isspace()) if units == "words" else not k or text[k - 1] == "\n")]
    assert len(found) == len(starts)
    for k in range(1, len(starts), 977):
        assert found.cut(k) == len(text[: starts[k]].encode())


def _by_hand(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    p, m, s = text[:a], text[a:b], text[b:]
    return (doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_transformed_texts_and_back(spark):
    rng = random.Random(3)
    texts = [None, "", "<P>", "a<M>b", "<", "<<", "P>", "\n", "\0", "é" * 99_999, "<S" * 500, "S>" * 500, "ab<" * 300] + ["".join(rng.choices("aé日\U0001f600<>PSM \n", k=rng.randrange(200))) for _ in range(300)]
    rows = [(k if k % 50 else None, t, 1, "x") for k, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, n string")
    done = fim.transform(docs.repartition(5))
    got = sorted(map(tuple, done.collect()), key=repr)
    assert got == sorted((_by_hand(r[0], r[1]) for r in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = sorted(r[0] for r in done.select(fim.restore(F.col("output"), F.col("form"))).collect())
    assert back == sorted(t or "" for _, t, _, _ in rows)
    assert fim.transform(docs.limit(0)).collect() == []
    assert [f.name for f in fim.digest(done).schema][:3] == ["doc_id", "n", "form"]


# vector codes


def _lloyd(rows, parts, entries, rounds, scale):
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    if not kept:
        return [], None
    w = len(kept[0][1]) // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * w : p * w + w] for r in first] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assigned():
        return [[min((dist(v[p * w : p * w + w], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for _, v in kept]

    for _ in range(rounds):
        now = assigned()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [v[p * w : p * w + w] for (_, v), a in zip(kept, now, strict=True) if a[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return sorted((repr(i), bytes(a[1] for a in x).hex(), sum(a[0] for a in x)) for (i, _), x in zip(kept, assigned(), strict=True)), books


@pytest.mark.parametrize("entries,spread", [(3, 2.0), (16, 0.01), (256, 40.0)])
def test_codes_are_those_of_full_scans(spark, entries, spread):
    rng = random.Random(entries)
    # few distinct numbers make many ties; ids repeat and are null
    rows = [(rng.choice([None, *range(150)]), [round(rng.uniform(-spread, spread), 2) for _ in range(8)]) for _ in range(300)]
    rows += rows[:40] + [(1, None), (2, [None] * 8), (3, [float("nan")] + [0.0] * 7), (4, [float("inf")] * 8), (5, [])]
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<float>, v int, row string").repartition(6)
    exact = [(i, [None if c is None else float(np.float32(c)) for c in v] if v is not None else None) for i, v in rows]
    got, books = vectors.compress(df, "vec_id", "embedding", entries=entries)
    assert got.columns == ["vec_id", "v", "row", "codes", "error"]
    wanted, entries_by_hand = _lloyd(exact, 4, entries, 4, 1024)
    assert sorted((repr(r["vec_id"]), bytes(r["codes"]).hex(), r["error"]) for r in got.collect()) == wanted
    assert books.entries.tolist() == entries_by_hand


def test_rescans_equal_scans_and_ties_go_to_the_lower_index():
    rng = np.random.default_rng(5)
    for trial in range(30):
        x, old = rng.integers(-4, 5, (200, 3)), rng.integers(-4, 5, (12, 3))
        new, moved = old.copy(), rng.random(12) < (0.0, 0.3, 1.0)[trial % 3]
        new[moved] = rng.integers(-4, 5, (int(moved.sum()), 3))
        for a, b in zip(vectors.rescan(x, new, moved, *vectors.scan(x, old)), vectors.scan(x, new), strict=True):
            assert (a == b).all()
        d = ((x[:, None, :] - new) ** 2).sum(axis=2)
        assert (vectors.scan(x, new)[0] == d.argmin(axis=1)).all()


def test_large_components_stay_exact():
    x, e = np.array([[1 << 26, -(1 << 26)]]), np.array([[-(1 << 26), 1 << 26], [1 << 26, 1 - (1 << 26)]])
    assert [v.tolist() for v in vectors.scan(x, e)] == [[1], [1]]
    assert vectors._distances(x, e)[0, 0] == 2 * (1 << 27) ** 2


def test_vectors_that_cannot_be_coded(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    rows, books = vectors.compress(frame([(1, None, "a")]), "vec_id", "embedding")
    assert vectors.digest(vectors.with_label_error(rows, "label"), books).collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        vectors.compress(frame([(1, [1.0] * 4, "a"), (2, [1.0] * 8, "a")]), "vec_id", "embedding")
    with pytest.raises(ValueError, match="equal parts"):
        vectors.compress(frame([(1, [1.0] * 6, "a")]), "vec_id", "embedding")
    with pytest.raises(Exception, match="beyond"):
        vectors.compress(frame([(1, [1e9] * 4, "a")]), "vec_id", "embedding")


@pytest.mark.parametrize("most", [0, 100])
def test_label_errors_put_nulls_together(spark, monkeypatch, most):
    monkeypatch.setattr(vectors, "BROADCAST_ROWS", most)
    rows = spark.createDataFrame([(1, "a", 5), (2, None, 1), (3, "a", 2), (4, None, 3)], "vec_id long, label string, error long")
    assert {r["vec_id"]: r["label_error"] for r in vectors.with_label_error(rows, "label").collect()} == {1: 7, 2: 4, 3: 7, 4: 4}


# archives


def _pages(spark):
    rng = random.Random(9)
    texts = [f"page {k} " + "".join(rng.choices("abcdefgh é\n", k=rng.randrange(3000))) for k in range(120)]
    rows = [(k, f"http://x.org/{k} a", texts[k % 90] if k % 7 else texts[0], "e") for k in range(200)]
    rows += [(500, None, None, "e"), (501, "", "", "e"), (502, "u\r\nX: y", "", "e"), (None, "n", "same", "e"), (None, "n", "same", "e"), (7, "http://x.org/7 a", rows[7][2], "e"), (7, "b", rows[7][2], "e"), (300, "z", "z" * 300_000, "e")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, key string")


def _wanted(rows, least=0):
    groups = {}
    for k, (i, url, html, _) in enumerate(rows):
        data = (html or "").encode()
        if i is not None and len(data) >= least:
            groups.setdefault(data, []).append((-i, url or "", k))
    out = []
    for k, (i, _, html, _) in enumerate(rows):
        data = (html or "").encode()
        order = sorted(groups.get(data, []))
        first = i is None or len(data) < least or order[0][2] == k
        out.append((i, len(data), warc.base32_sha1(data), "response" if first else "revisit", None if first else -order[0][0]))
    return sorted(out, key=repr)


@pytest.fixture
def place(tmp_path):
    return lambda name: (tmp_path / name).as_uri()


def _files(uri):
    root = Path(urllib.parse.urlparse(uri).path)
    return {p.name: p.read_bytes() for p in root.glob("*.warc.gz")}


@pytest.mark.parametrize("least", [0, 1, 500])
def test_archives_hold_every_page_once(spark, place, least):
    rows, df = _pages(spark)
    listed = warc.write_archives(df, place("a"), revisit_bytes=least, roll_bytes=20_000, shard_bytes=50_000).collect()
    found = warc.read_archives(spark, place("a"), batch_bytes=50_000)
    assert sorted(map(tuple, warc.digest(found, "long").collect()), key=repr) == _wanted(rows, least)
    texts = {r["id"]: r["payload"] for r in found.where("record_type = 'response' and id is not null").collect()}
    assert all(texts[str(i)] == bytearray((html or "").encode()) for i, _, html, _ in rows if str(i) in texts)
    files = _files(place("a"))
    assert {r["name"]: (r["bytes"], r["sha256"]) for r in listed} == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in files.items()}
    assert sum(r["records"] for r in listed) == len(rows) and len({r["shard"] for r in listed}) > 1 and any(r["part"] for r in listed)
    # a file goes on until it holds the limit, so all but the last of a shard do
    last = {r["shard"]: max(x["part"] for x in listed if x["shard"] == r["shard"]) for r in listed}
    assert all(r["bytes"] >= 20_000 for r in listed if r["part"] < last[r["shard"]])


def test_archives_do_not_depend_on_the_partitioning(spark, place):
    _, df = _pages(spark)
    made = []
    for k, (parts, shuffle) in enumerate([(1, "4"), (13, "7"), (5, "200")]):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
        try:
            warc.write_archives(df.repartition(parts), place(f"d{k}"), roll_bytes=20_000, shard_bytes=50_000)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        made.append(_files(place(f"d{k}")))
    assert made[0] == made[1] == made[2] and len(made[0]) > 5


def test_archives_by_ids_of_text_and_by_shuffled_revisits(spark, place, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    rows = [("a", "u", "x"), ("c", "v", "x"), ("b", "w", "x"), ("d", "w", "y")]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    warc.write_archives(df, place("t"))
    found = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.digest(warc.read_archives(spark, place("t")), "string").collect()}
    assert found == {"a": ("revisit", "c"), "b": ("revisit", "c"), "c": ("response", None), "d": ("response", None)}


def test_archives_of_nothing(spark, place):
    _, df = _pages(spark)
    assert warc.write_archives(df.limit(0), place("e")).collect() == []
    assert warc.read_archives(spark, place("e")).collect() == []


def test_damaged_archives_and_foreign_files(spark, place):
    _, df = _pages(spark)
    name = warc.write_archives(df, place("f")).first()["name"]
    root = Path(urllib.parse.urlparse(place("f")).path)
    (root / "9999999-0000.warc.gz").write_bytes(b"left by an attempt that was lost")
    assert warc.read_archives(spark, place("f")).count() == df.count()
    data = (root / name).read_bytes()
    (root / name).write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception, match="EOFError|damaged|Error"):
        warc.read_archives(spark, place("f")).collect()


def test_renaming_again_changes_nothing(spark, place):
    _, df = _pages(spark)
    warc.write_archives(df, place("g"))
    staged = spark.read.schema(warc._MANIFEST).parquet(f"{place('g')}/_staged")
    before = _files(place("g"))
    assert warc._committed(staged, place("g")).count() == staged.count()
    assert _files(place("g")) == before


def test_headers_of_a_record(spark, place):
    df = spark.createDataFrame([(1, "http://h/ü b", "same"), (2, "http://h/2", "same")], "page_id long, url string, html string")
    name = warc.write_archives(df, place("h")).first()["name"]
    with (Path(urllib.parse.urlparse(place("h")).path) / name).open("rb") as f:
        (one, block), (two, page) = warc.records(f)
    assert one["WARC-Type"] == "revisit" and one["WARC-Target-URI"] == "http://h/ü%20b" and one["WARC-Refers-To"] == two["WARC-Record-ID"] and one["WARC-Refers-To-Target-URI"] == "http://h/2"
    assert block.endswith(b"Content-Length: 4\r\n\r\n") and page.endswith(b"\r\n\r\nsame")
    assert one["WARC-Payload-Digest"] == two["WARC-Payload-Digest"] == f"sha1:{warc.base32_sha1(b'same')}"
