"""Each operator against brute force on small tables, with nulls, empty texts, ties, repeats and extra columns."""

import base64
import hashlib
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from strandweave.llm import ann, bpe, common, components, ego, htmltext, langid, packing, quality, shingles, simhash, simple8b, vectors, warc  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string"
TEXTS = [
    "The cat sat on the mat.", "", None, "it's  a\n\n x\t'll we've DON'T", " leading", "trailing ", "\n", "  ", "a\nb c\nd",
    "é’s naïve coöp 日本語 テスト 🙂🙂 x", "1½² ٣ abc_def's 'tis", "<|endoftext|> x", "word " * 4000, "x" * 5000, "a\x00b \x7f c", "a b c d",
    "a\tb  c", "word\tword2  end of it", "x\xa0y  z", "a\tb \nc",
]


def documents(spark, texts, lang=None):
    rows = [(i, t, (lang or {}).get(i, "en"), "s", 0, 0.5, "f") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "no id here", None, None, None, None, None), rows[0]], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t


PATH = public_tokenizers.path("byte_bpe_50k.json")


# 1


def test_warc_round_trip_matches_brute_force(spark):
    body = "p" * 150
    htmls = [body, "short", body, None, "", body, "é" * 60, "é" * 60, "short", "z" * 100000]
    rows = [(i, f"http://x/{i}", h, "extra") for i, h in enumerate(htmls)] + [(None, None, body, "e"), (2, "http://x/2", body, "e")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    folder = common.shared_folder(spark, "t")
    read = warc.read_archives(warc.write_archives(warc.with_revisits(pages), folder, archive_bytes=300)).collect()
    assert len(read) == len(rows)
    firsts = {}
    for i, _, h, _ in rows:
        b = (h or "").encode()
        if i is not None and len(b) >= 100:
            firsts[b] = min(firsts.get(b, i), i)
    want = sorted(
        (str(i), len(b := (h or "").encode()), hashlib.sha256(b).hexdigest(), "revisit" if i is not None and i > firsts.get(b, i) else "response",
         firsts[b] if i is not None and i > firsts.get(b, i) else None) for i, _, h, _ in rows
    )
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read) == want
    assert all(bytes(r.payload) == (dict((x[0], x[2]) for x in rows)[r.page_id] or "").encode() for r in read if r.record_type == "response")


def test_warc_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(warc.with_revisits(pages), common.shared_folder(spark, "t"))).count() == 0


def test_warc_reads_foreign_archives(spark, tmp_path):
    import gzip

    def record(kind, lines, block):
        head = [f"warc-type:{kind}", f"WARC-Record-ID: <urn:uuid:{kind}>", *lines, f"Content-Length: {len(block)}"]
        return gzip.compress(("WARC/1.0\r\n" + "\r\n".join(head)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    named = ["WARC-Target-URI: <http://a.b/c>", "Content-Type: application/http; msgtype=response"]
    info = record("warcinfo", ["Content-Type: application/warc-fields"], b"software: x\r\n")
    one = record("response", [*named, "WARC-Payload-Digest: sha1:ABC"], http + b"<p>one")
    two, three = record("response", named, http + b"<p>two"), record("revisit", [*named, "WARC-Refers-To: <urn:uuid:response>"], http)
    path = tmp_path / "f.wacz"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("archive/a.warc.gz", info + one)
        z.writestr("archive/b.warc.gz", two + three)
        lines = "!meta {}\n" + "".join(f'b,a)/c 2024 {{"offset": "{at}", "length": "{n}", "filename": "a.warc.gz"}}\n' for at, n in ((len(info), len(one)), (0, len(info))))
        z.writestr("indexes/index.cdx.gz", gzip.compress(lines.encode()))
    rows = warc.read_archives(spark.createDataFrame([(f"file://{path}",)], "path string")).collect()
    found = sorted((r.record_type, r.url, bytes(r.payload), r.payload_digest) for r in rows)
    sha = hashlib.sha256(b"<p>two").hexdigest()
    assert found == [
        ("response", "http://a.b/c", b"<p>one", "sha1:ABC"), ("response", "http://a.b/c", b"<p>two", sha),
        ("revisit", "http://a.b/c", b"", ""), ("warcinfo", "", b"software: x\r\n", hashlib.sha256(b"software: x\r\n").hexdigest()),
    ]
    assert all(r.page_id is None and r.refers_to is None for r in rows)


def test_zip64_directory(tmp_path):
    path = tmp_path / "z.zip"
    with zipfile.ZipFile(path, "w") as z:
        with z.open("archive/data", "w", force_zip64=True) as f:
            f.write(b"stored bytes")
        z.writestr("packed", b"x" * 1000, zipfile.ZIP_DEFLATED)
        z.comment = b"with PK\x05\x06 in it"
    raw = path.read_bytes()
    with path.open("rb") as f:
        d = warc.ZipDirectory(f, len(raw))
        assert d.read("archive/data") == b"stored bytes"
        with pytest.raises(ValueError):
            d.place("packed")
    # The same file with its directory told by ZIP64 records only.
    end = raw.rfind(b"PK\x05\x06", 0, raw.rfind(b"with PK"))
    entries, length, start = struct.unpack("<HII", raw[end + 10 : end + 20])
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, entries, entries, length, start)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, end, 1)
    tail = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    path.write_bytes(raw[:end] + end64 + locator + tail)
    with path.open("rb") as f:
        assert warc.ZipDirectory(f, path.stat().st_size).read("archive/data") == b"stored bytes"


# 2 and 10


def ids_of(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 0]


def test_packing_covers_every_id_once(spark):
    docs = documents(spark, TEXTS)
    rows = packing.pack(docs, PATH).collect()
    source = {None: "no id here"} | dict(enumerate(TEXTS))
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(source)
    for doc_id, pieces in by_doc.items():
        ids, copies = ids_of(source[doc_id]), 2 if doc_id == 0 else 1
        assert sum(p.length for p in pieces) == copies * len(ids)
        for p in pieces:
            assert p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(empty(spark), PATH).count() == 0


def test_packing_leaves_little_padding(spark):
    rng = random.Random(2)
    docs = documents(spark, [" ".join("w" * rng.randint(1, 9) for _ in range(rng.choice([5, 60, 300, 2000]))) for _ in range(600)])
    rows = packing.pack(docs.coalesce(1), PATH).collect()
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert sum(used.values()) >= 0.98 * 1024 * len(used)


def test_best_fit_decreasing_matches_brute_force():
    rng = random.Random(5)
    for _ in range(50):
        lengths = [rng.randint(1, 40) for _ in range(rng.randint(0, 80))]
        got = packing.best_fit_decreasing(lengths, 40)
        room = []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [r for r in room if r >= lengths[i]]
            if fits:
                room.remove(min(fits))
            room.append((min(fits) if fits else 40) - lengths[i])
        used = {}
        for (w, at), n in zip(got, lengths):
            used[w] = used.get(w, 0) + n
        assert sorted(40 - u for u in used.values()) == sorted(room)


def test_ids_round_trip_through_files(spark):
    docs = documents(spark, TEXTS)
    rows = simple8b.read_shards(simple8b.write_shards(docs, PATH, common.shared_folder(spark, "t"))).collect()
    order = sorted([(-1, "no id here"), *((i, t) for i, t in enumerate(TEXTS)), (0, TEXTS[0])], key=lambda x: x[0])
    start, want = 0, []
    for i, t in order:
        ids = ids_of(t)
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows) == sorted(want)
    assert simple8b.read_shards(simple8b.write_shards(empty(spark), PATH, common.shared_folder(spark, "t"))).count() == 0


@pytest.mark.parametrize("kind", ["ids", "bits", "wide", "huge", "none"])
def test_simple8b_round_trip(kind):
    rng = np.random.default_rng(2)
    values = {
        "ids": rng.integers(0, 50257, 10000), "bits": rng.integers(0, 2, 9000), "wide": (2 ** rng.uniform(0, 63.9, 5000)).astype(np.uint64),
        "huge": np.array([2**64 - 1, 0, 2**60, 2**60 - 1], np.uint64), "none": np.zeros(0),
    }[kind].astype(np.uint64)
    words, escapes, sizes = simple8b.encode_blocks(values)
    assert np.array_equal(simple8b.decode_blocks(words, escapes, sizes, len(values)), values)


def test_shard_with_runs_and_escapes(tmp_path):
    rng = np.random.default_rng(3)
    writer = simple8b.ShardWriter(f"file://{tmp_path}/a.s8b")
    writer.RUN = 2 * simple8b.BLOCK
    docs = [(2 ** rng.uniform(0, 62, n)).astype(np.uint64) for n in (0, 5, 9000, 1, 4096, 20000)]
    for i, d in enumerate(docs):
        writer.add(i or None, d)
    writer.close()
    path = tmp_path / "a.s8b"
    with path.open("rb") as f:
        reader = simple8b.ShardReader(f, path.stat().st_size)
        assert np.array_equal(reader.run(0, reader.blocks), np.concatenate(docs))
        got = list(reader.documents(blocks_each=1))
    assert got == [(i or None, len(d), zlib.crc32(d.astype("<u4").tobytes())) for i, d in enumerate(docs)]


# 3


def test_bpe_equals_tiktoken(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    noise = ["".join(rng.choice(" \n\t'aslvedrtm1½_.!é　\x1c") for _ in range(rng.randrange(40))) for _ in range(400)]
    docs = documents(spark, TEXTS + noise)
    rows = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, path), path).mapInArrow(bpe._digests, bpe.DIGESTS).collect()}
    for i, t in enumerate(TEXTS + noise):
        ids = reference.encode_ordinary(t or "")
        assert (rows[i].n_tokens, rows[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.decode(bpe.encode(empty(spark), path), path).count() == 0


# 4 and 9


def vector_table(spark, matrix, extra=()):
    rows = [(i, [float(x) for x in v], 0, 1.0) for i, v in enumerate(matrix)]
    return spark.createDataFrame([*rows, *extra], "vec_id long, embedding array<float>, label int, score double")


BAD = [(9001, None, 0, 0.0), (9002, [0.0] * 16, 0, 0.0), (9003, [None] + [1.0] * 15, 0, 0.0), (9004, [float("nan")] * 16, 0, 0.0), (9005, [float("inf")] * 16, 0, 0.0), (None, [1.0] * 16, 0, 0.0), (9006, [], 0, 0.0)]


def exact(matrix):
    m = matrix.astype(np.float32).astype(np.float64)
    return (m @ m.T) / np.outer(*(np.linalg.norm(m, axis=1),) * 2)


def test_nearest_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 300)
    monkeypatch.setattr(ann, "SHARD_ROWS", 200)
    rng = np.random.default_rng(4)
    m = rng.standard_normal((1500, 16))
    m[100:400] = m[100] * np.linspace(0.5, 2, 300)[:, None]
    m[400:430] = m[400]
    v = vector_table(spark, m, BAD)
    got = ann.nearest(v, v.where("vec_id % 50 = 0")).collect()
    cos = exact(m)
    np.fill_diagonal(cos, -2)
    hits = total = 0
    for q in range(0, 1500, 50):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - cos[q, r.vec_id]) < 1e-9 for r in mine)
        fifth = np.sort(cos[q])[-5]
        hits += sum(r.score >= fifth - 1e-9 for r in mine)
        total += 5
        if q == 400:
            assert [r.vec_id for r in mine] == [401, 402, 403, 404, 405]
    assert hits / total >= 0.9
    assert {r.query_id for r in got} == set(range(0, 1500, 50))
    few = vector_table(spark, m[:3])
    assert ann.nearest(few, few.where("vec_id = 0")).count() == 2
    none = vector_table(spark, m[:0])
    assert ann.nearest(none, none).count() == 0


def brute_components(linked):
    n = len(linked)
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([label[i], *(label[j] for j in np.flatnonzero(linked[i]))])
            if low < label[i]:
                label[i], changed = low, True
    return label


def test_grid_order_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ego, "BLOCK_ROWS", 64)
    monkeypatch.setattr(ego, "PART_ROWS", 16)
    rng = np.random.default_rng(6)
    m = rng.standard_normal((400, 16))
    m[50:90] = m[50] + 0.15 * rng.standard_normal((40, 16))
    m[90:120] = m[90]
    m[200:260] = m[200] + np.cumsum(0.12 * rng.standard_normal((60, 16)), axis=0)
    rows = {r.vec_id: r for r in ego.near_duplicates(vector_table(spark, m, BAD)).collect() if r.vec_id is not None}
    linked = exact(m) >= 0.95
    np.fill_diagonal(linked, False)
    label = brute_components(linked)
    assert [rows[i].n_links for i in range(400)] == linked.sum(axis=1).tolist()
    assert [rows[i].component_id for i in range(400)] == label
    assert all(rows[i].kept == (label[i] == i) for i in range(400))
    assert rows[9004].n_links == 0 and rows[9004].component_id == 9004 and rows[9004].kept
    assert ego.near_duplicates(vector_table(spark, m[:0])).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(8)
    names = rng.permutation(400).tolist()
    edges = [(names[i], names[i + 1]) for i in range(199)] + [(names[200], names[i]) for i in range(201, 300)] + [(5000, 5000)]
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[n] for n in names[:200]} == {min(names[:200])} and {got[n] for n in names[200:300]} == {min(names[200:300])}
    assert len(got) == 300
    assert components.connected(spark.createDataFrame([], "u long, v long")).count() == 0


# 5


def brute_fingerprint(text):
    import re

    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def varied(n=160, seed=9):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.5:
            base = rng.choice(texts).split()
            base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(base))
        else:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.choice([2, 30, 300]))))
    return texts


@pytest.mark.parametrize("bucket_rows", [simhash.BUCKET_ROWS, 4, 1])
def test_simhash_equals_brute_force(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(simhash.links, "__defaults__", (bucket_rows,))
    texts = TEXTS + varied() + ["\t\n ", "Two words", "TWO   WORDS"]
    rows = {r.doc_id: r for r in simhash.near_duplicates(documents(spark, texts)).collect() if r.doc_id is not None}
    prints = [brute_fingerprint(t) for t in texts]
    assert [rows[i].fp & (2**64 - 1) for i in range(len(texts))] == prints
    linked = np.array([[i != j and (a ^ b).bit_count() <= 3 for j, b in enumerate(prints)] for i, a in enumerate(prints)])
    assert [rows[i].component_id for i in range(len(texts))] == brute_components(linked)
    kept = simhash.keep_one(documents(spark, texts))
    assert kept.columns == documents(spark, texts).columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(brute_components(linked))) and ids.count(None) == 1
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.keep_one(empty(spark)).count() == 0


def test_keep_one_passes_clashing_names(spark):
    rows = [(1, "same words here", 7, "k", 3), (2, "same words here", 8, "l", 4), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row0 int, __kept string, component_id int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} == {rows[0], rows[2]}


def edited(seed=21):
    """Texts and copies with 1 to 30 words replaced, among them a chain and a group of copies edited apart."""
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([40, 240, 600]))) for _ in range(40)]
    for base in texts[:40] + [texts[1]] * 20:
        copy = base.split()
        for _ in range(rng.randrange(1, max(2, len(copy) // 20))):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
        texts.append(" ".join(copy[: -len(copy) // 9]))
    return texts


@pytest.mark.parametrize("block_nodes", [shingles.BLOCK_NODES, 3])
def test_pipeline_copies_equal_brute_force_jaccard(spark, monkeypatch, block_nodes):
    monkeypatch.setattr(shingles, "BLOCK_NODES", block_nodes)
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    texts = TEXTS + edited() + ["\t\n ", "Two words", "TWO   WORDS"]
    cut = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in cut]
    linked = np.array([[i != j and (a == b or 5 * len(a & b) >= 4 * len(a | b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    prints = [simhash.fingerprint(t) for t in texts]
    assert sum((prints[i] ^ prints[j]).bit_count() > 3 for i, j in zip(*np.nonzero(linked))) > 50
    want = brute_components(linked)
    rows = {r.doc_id: r.component_id for r in shingles.near_duplicates(documents(spark, texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == want and rows[None] is None
    ids = [r.doc_id for r in corpus_pipeline.keep_one_of_copies(spark, documents(spark, texts), "").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want)) and ids.count(None) == 1
    assert corpus_pipeline.keep_one_of_copies(spark, empty(spark), "").count() == 0


def test_shingle_blocks_find_all_links_of_their_hubs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 100).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(100) < rng.choice([0.05, 0.15]), rng.integers(0, 2**63, 100).astype(np.uint64), base)) for _ in range(60)]

    def block(rows):
        hub = np.array([7 if i < 40 else 9 for i in rows])
        return shingles.Nodes(hub, np.array(rows), np.array([i // 2 for i in rows]), np.cumsum([0, *(len(sets[i]) for i in rows)]), np.concatenate([sets[i] for i in rows]))

    def brute(a, b):
        pairs = ((i, j) for i in a for j in b if (i < 40) == (j < 40) and i // 2 != j // 2)
        return [(i, j) for i, j in pairs if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]

    for a, b in ((list(range(60)), None), (list(range(0, 25)), list(range(25, 60)))):
        one = block(a)
        two = one if b is None else block(b)
        for i, found in zip(a, shingles.overlaps(one, two)):
            assert all(n == len(np.intersect1d(sets[i], sets[j])) for j, n in zip(b or a, found) if i != j)
        got = np.eye(60, dtype=bool)
        for u, v in shingles.links_between(one, two):
            got[u, v] = got[v, u] = True
        want = np.eye(60, dtype=bool)
        for i, j in brute(a, b or a):
            want[i, j] = want[j, i] = True
        assert brute_components(got) == brute_components(want) and want.sum() > 100


def test_pigeonring_loses_no_pair():
    rng = np.random.default_rng(10)
    a = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    b = a.copy()
    for _ in range(5):
        flip = rng.integers(0, 64, len(a)).astype(np.uint64)
        b = np.where(rng.random(len(a)) < 0.6, b ^ (np.uint64(1) << flip), b)
    near = np.bitwise_count(a ^ b) <= 3
    found = np.zeros(len(a), bool)
    for first in range(4):
        found |= simhash.within_chain(a, b, np.full(len(a), first))
    assert np.array_equal(near, found)


# 6 and 7


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_quality_held_out_accuracy_and_edges(spark):
    rng = random.Random(12)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "magna", "erat", "vel"]
    texts, marks = [], []
    for i in range(300):
        good = i % 4 != 0
        t = prose(rng, words, rng.randint(20, 80))
        texts.append(t if good else rng.choice([t.upper() + "!!", t.replace(" ", " | "), " ".join(w + "%%%" for w in t.split())]))
        marks.append((i, int(good), 0))
    docs = documents(spark, [*texts, "", None])
    labels = spark.createDataFrame([*marks, (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    rows = {r.doc_id: r for r in quality.scored(docs, model).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(rows[i].held_out == (i in held) for i in range(300)) and rows[None].held_out is False
    assert np.mean([rows[i].predicted == marks[i][1] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows.values())
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.predicted}
    unseen = quality.fit(docs, labels.where("false"))
    assert quality.accepted(docs, unseen).count() == docs.count()
    assert quality.scored(empty(spark), model).count() == 0


def test_quality_training_equals_a_plain_version():
    rng = random.Random(5)
    rows = []
    for i in range(12):
        grams, counts = np.unique(quality.features(prose(rng, ["ab", "Cd!", "12", "ef"] if i % 3 else ["xy", "zz"], 9)), return_counts=True)
        rows.append((grams, (counts / counts.sum()).astype(np.float32), int(i % 3 > 0)))
    model = quality.train(rows)
    z, n, size = {}, {}, 1 << quality.BITS
    ones = sum(r[2] for r in rows)

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= quality.L1 else -(zi - np.sign(zi) * quality.L1) / ((quality.BETA + n.get(i, 0.0) ** 0.5) / quality.ALPHA + quality.L2)

    order = np.random.default_rng(1)
    for _ in range(quality.EPOCHS):
        for k in order.permutation(len(rows)).tolist():
            x = dict(zip(rows[k][0].tolist(), (quality.SCALE * rows[k][1].astype(float)).tolist())) | {size: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * x[i] for i in x)))
            share = len(rows) / (2 * (ones if rows[k][2] else len(rows) - ones))
            for i, v in x.items():
                g = share * (p - rows[k][2]) * v
                z[i] = z.get(i, 0.0) + g - ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / quality.ALPHA * w[i]
                n[i] = n.get(i, 0.0) + g * g
    assert model.bias == pytest.approx(weight(size), abs=1e-9)
    assert all(model.weights[i] == pytest.approx(weight(i), abs=1e-5) for i in z if i < size)


def test_quality_features_have_word_pairs_and_triples():
    one, other = (set(quality.features(t).tolist()) for t in ("big red dog", "red big dog"))
    assert one != other and len(quality.features("big red dog")) == 12


def test_language_training_equals_a_plain_version():
    rows = [s for i, (t, lang) in enumerate([("der hund", "de"), ("the dog", "en"), ("ein haus", "de"), ("a house", "en")] * 2) for s in langid.samples(t, lang, i)]
    model = langid.train(rows, seed=3)
    rng = np.random.default_rng(3)
    fitting = [r for r in rows if not r[3]]
    table = rng.uniform(-1, 1, (langid.BUCKETS, langid.DIMS)) / langid.DIMS
    out, bias, names = np.zeros((langid.DIMS, 2)), np.zeros(2), ["de", "en"]
    share = [sum(r[2] == n for r in fitting) / len(fitting) for n in names]
    done, steps = 0, langid.EPOCHS * len(fitting)
    for _ in range(langid.EPOCHS):
        for k in rng.permutation(len(fitting)):
            at, weight, lang, _ = fitting[k]
            rate, done = langid.RATE * (1 - done / steps), done + 1
            mean = sum(w * table[i] for i, w in zip(at, weight))
            e = np.exp(mean @ out + bias)
            step = (e / e.sum() - np.array([n == lang for n in names])) * min(4.0, 1 / (2 * share[names.index(lang)]))
            back = [sum(out[d, c] * step[c] for c in range(2)) for d in range(langid.DIMS)]
            for c in range(2):
                out[:, c] -= rate * step[c] * mean
                bias[c] -= 0.01 * rate * step[c]
            for i, w in zip(at, weight):
                table[i] -= rate * len(at) ** 0.5 * w * np.array(back)
    assert np.allclose(model.logits, table @ out, atol=1e-9) and np.allclose(model.bias, bias)


def test_forms_are_of_whole_words():
    assert quality.form("a1" * 150 + "。!!") == "a0" * 150 + "。!"
    one, other = (quality.features("中、" * 150 + end) for end in ("好。", "!!?12"))
    assert one[1] != other[1]


def test_language_held_out_accuracy_and_edges(spark):
    rng = random.Random(13)
    parts = {"xa": ["kor", "ta", "mu"], "xb": ["schl", "ig", "en"], "xc": ["oui", "eau", "é"]}
    texts, lang = [], {}
    for i in range(300):
        name = rng.choice(list(parts))
        lang[i] = name
        texts.append(" ".join("".join(rng.choice(parts[name]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 60))))
    docs = documents(spark, [*texts, "", None, "123 !?", "½"], lang | {300: None, 301: "xa", 302: "xb", 303: None})
    model = langid.fit(docs)
    rows = {r.doc_id: r for r in langid.predicted(docs, model).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([rows[i].lang_pred == lang[i] for i in held]) > 0.97
    assert all(rows[i].lang_pred == "und" and not rows[i].accepted for i in (300, 301, 302, 303))
    assert sum(rows[i].accepted for i in range(300)) > 290
    assert {r.doc_id for r in langid.accepted(docs, model).collect()} == {i for i, r in rows.items() if r.accepted}
    assert langid.fit(empty(spark)).predict("word")[0] == "und"


def test_subwords_equal_brute_force():
    words = ["it's", "Über-cool", "123", "a", "½x½", "日本", "don"]
    buckets, of = langid.subwords(words)
    for i, w in enumerate(words):
        runs = "".join(c if c.isalpha() else " " for c in w.lower()).split()
        grams = [f"<{r}>"[k : k + n] for r in runs for n in range(1, 5) for k in range(len(r) + 3 - n) if n > 1 or 0 < k <= len(r)]
        assert (of == i).sum() == len(grams)
    alone = [sorted(langid.subwords([w])[0].tolist()) for w in words]
    assert [sorted(buckets[of == i].tolist()) for i in range(len(words))] == alone
    assert alone[3] != alone[6] and len(langid.subwords([])[0]) == 0


# 8


def test_html_model_on_unseen_pages():
    model, writer = htmltext.default_model(), htmltext.PageWriter(77)
    right = total = 0
    for _ in range(150):
        keys, labels, page, main = htmltext.labelled_page(writer)
        got = model.decode(keys)
        right += sum(a == b for a, b in zip(got, labels))
        total += len(labels)
    assert right / total > 0.97


def test_viterbi_equals_brute_force():
    from itertools import product

    model, writer = htmltext.default_model(), htmltext.PageWriter(5)
    for _ in range(20):
        keys = htmltext.labelled_page(writer)[0][:8]
        e = [model.emission(k) for k in keys]

        def score(y, e=e):
            s = model.first[y[0]] + model.last[y[-1]] + sum(e[i][c] for i, c in enumerate(y))
            return s + sum(model.moves[a, b] for a, b in zip(y, y[1:]))

        best = max(product((0, 1), repeat=len(keys)), key=score)
        assert score(best) == pytest.approx(score(model.decode(keys)))


def test_html_extraction_and_edges(spark):
    page = (
        "<html><head><title>T</title><script>var a='</p>';</script></head><body><header><a href=/>Site</a></header><nav><ul><li><a href=/>Home</a></li></ul></nav>"
        '<div class="cookie-notice"><p>We use cookies, accept them.</p></div><article><h1>Big &amp; bold</h1><p>First&nbsp; para\n with <b>bold</b> text, long enough.<p>Second para<br>here, with more words.'
        '<div class="ad">Buy this now.</div><!-- gone --><p>Third one, after the advert.</p></article><section class="comments"><p>I liked the article, said a reader.</p></section>'
        '<aside><p>Related story.</p></aside><form><label>Mail</label><button>Send</button></form><footer>&copy; site</footer></body>'
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p"), (None, "u", "<div><div>")]
    got = {r.page_id: r for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "Big & bold\nFirst para with bold text, long enough.\nSecond para here, with more words.\nThird one, after the advert."
    assert got[1].n_chars == len(got[1].text)
    assert got[2].text == "" and got[3].n_chars == 0 and len(got) == 5


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p>One.</p><svg-icon name=x></svg-icon><p>Two.</p>", ["One.", "Two."]),
        ('<p>One <svg title="a>b"/> more.</p><p>Two.</p>', ["One more.", "Two."]),
        ("<p>One.</p><svg><p>Two.</p>", ["One.", "Two."]),
        ("<p>One.</p><select-menu><object-view></object-view><p>Two.</p>", ["One.", "Two."]),
        ("<p>If <math><mi>x</mi><mo>=</mo><mn>1</mn></math> then.</p>", ["If x=1 then."]),
        ("<noscript><p>One.</p></noscript><object data=a>Two.</object><p>Three.", ["One.", "Two.", "Three."]),
        ("<p>One.</p><svg><text>drawn</text></svg><template>t</template><style>p{}</style><script>'<p>'</script ><p>Two.</p>", ["One.", "Two."]),
        ("<p>One.</p><script>var a = '<p>code</p>';", ["One."]),
    ],
)
def test_html_raw_elements_hide_no_text(page, want):
    assert [b[0] for b in htmltext.blocks(page)] == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p class=a'b>Stray</p>", ["Stray"]), ('<p title="a>b">Quoted</p>', ["Quoted"]), ('<p title="a>One</p><p>Two</p>', ["One", "Two"]),
        ("a < b and <3", ["a < b and <3"]), ("<p>One<p", ["One"]), ("<!--><p>One<!-- x", ["One"]),
    ],
)
def test_html_malformed_markup_is_never_text(page, want):
    assert [b[0] for b in htmltext.blocks(page)] == want


@pytest.mark.parametrize("unit", ['<a title="x ', '<a title="x>', "<a x='\">", "<script ", "<li>", '<a b="\'" c=\'"\'>', "</x><div>"])
def test_html_of_a_megabyte_takes_linear_time(unit):
    import time

    def took(n):
        began = time.process_time()
        htmltext.blocks(unit * (n // len(unit)))
        return time.process_time() - began

    assert took(1_000_000) < 20 * max(0.05, took(100_000))


def test_html_copyright_sign_is_seen_anywhere():
    assert htmltext._form("word " * 60 + "© x.", 0) != htmltext._form("word " * 60 + "c x.", 0)


# The pipeline


def test_pipeline_stages_compose(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(14)
    words = ["lorem", "ipsum", "dolor", "amet", "magna", "erat"] + [f"vel{c}" for c in "abcdefghij"]
    texts = [prose(rng, words, 60) for _ in range(60)]
    texts += [texts[0], texts[1]] + [prose(rng, words, 40).upper() + "!!" for _ in range(15)] + ["12345", "", None]
    docs = documents(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(not (62 <= i < 77)), 0) for i in range(77)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = common.stored(stage(spark, now, str(tmp_path)), "t")
        assert now.columns == docs.columns
        sizes.append({r.doc_id for r in now.collect()})
    assert not sizes[0] & set(range(62, 77)) and set(range(62)) <= sizes[0]
    assert not sizes[1] & {77, 78, 79}
    assert {60, 61} & sizes[2] == set() and {0, 1} <= sizes[2]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == sizes[2]


def test_usable_vectors(spark):
    good, sizes = vectors.usable(vector_table(spark, np.eye(16), BAD))
    assert sizes == [16] and {r.vec_id for r in good.collect()} == set(range(16))
