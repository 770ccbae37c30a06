"""Archives that others write, and pages with long attributes."""

import gzip
import json
import zipfile

import pytest

pytest.importorskip("public_tokenizers")
from strandweave.llm import htmltext, warc  # noqa: E402

RECORDS = [warc.record_bytes(i, f"http://x/{i}", b"payload %d " % i * 30, "", None, "2024-01-01T00:00:00Z").replace(b"WARC-Payload-Digest: sha256:\r\n", b"") for i in range(5)]


def archive(tmp_path, name, member, data, index=None):
    path = tmp_path / name
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as out:
        out.writestr(f"archive/{member}", data)
        if index is not None:
            lines = "".join(f"x 2024 {json.dumps({'filename': member, 'offset': a, 'length': n})}\n" for a, n in index)
            out.writestr("indexes/index.cdx.gz", gzip.compress(lines.encode()))
    return f"file://{path}"


def read(spark, *paths):
    got = warc.read_archives(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    return sorted((r.page_id, bytes(r.payload)) for r in got)


WANT = [(i, b"payload %d " % i * 30) for i in range(5)]


def test_every_form_of_an_archive_gives_every_record(spark, tmp_path):
    each = [gzip.compress(r) for r in RECORDS]
    ends = [sum(map(len, each[:k])) for k in range(6)]
    plain_ends = [sum(map(len, RECORDS[:k])) for k in range(6)]
    paths = [
        archive(tmp_path, "whole.wacz", "a.warc.gz", gzip.compress(b"".join(RECORDS))),
        archive(tmp_path, "plain.wacz", "a.warc", b"".join(RECORDS)),
        archive(tmp_path, "plain_index.wacz", "a.warc", b"".join(RECORDS), [(plain_ends[k], plain_ends[k + 1] - plain_ends[k]) for k in range(5)]),
        archive(tmp_path, "partly.wacz", "a.warc.gz", b"".join(each), [(ends[1], len(each[1]))]),
        archive(tmp_path, "mixed.wacz", "a.warc.gz", gzip.compress(RECORDS[0] + RECORDS[1]) + gzip.compress(b"".join(RECORDS[2:]))),
        archive(tmp_path, "indexed.wacz", "a.warc.gz", b"".join(each), [(ends[k], len(each[k])) for k in (3, 1, 0, 4, 2, 2)]),
        archive(tmp_path, "none.wacz", "a.warc", b""),
    ]
    for path in paths[:-1]:
        assert read(spark, path) == WANT, path
    assert read(spark, *paths) == sorted(WANT * 6)


def test_a_large_member_is_read_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_BYTES", 100)
    monkeypatch.setattr(warc, "PIECE_BYTES", 37)
    with open(tmp_path / "f", "wb") as out:
        out.write(gzip.compress(b"".join(RECORDS)))
    with open(tmp_path / "f", "rb") as file:
        size = (tmp_path / "f").stat().st_size
        assert list(warc._raw_records(file, 0, [size], True)) == [r[:-4] for r in RECORDS]


@pytest.mark.parametrize("data, member", [(gzip.compress(b"".join(RECORDS))[:-9], "a.warc.gz"), (b"".join(RECORDS)[:-40], "a.warc"), (gzip.compress(b"".join(RECORDS)[:-40]), "a.warc.gz"), (b"junk", "a.warc")])
def test_a_cut_archive_is_named(spark, tmp_path, data, member):
    with pytest.raises(Exception, match="cut.wacz"):
        read(spark, archive(tmp_path, "cut.wacz", member, data))


def test_long_attributes_arent_kept_and_hints_are_of_their_own_attributes():
    before = htmltext._seen_mask.cache_info().currsize
    long = 'style="' + "x" * 100_000 + '" class="sidebar"'
    assert htmltext._mask("div", long) == htmltext._mask("div", 'class="sidebar"') != htmltext._mask("div", "")
    assert htmltext._seen_mask.cache_info().currsize <= before + 2
    assert htmltext._mask("div", 'data-class="sidebar" data-id=footer x:role=nav') == htmltext._mask("div", "")
