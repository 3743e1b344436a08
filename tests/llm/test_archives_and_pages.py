"""Archives, main text of pages, token files."""

import io
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stratapanel.llm import html_text, token_ids, warc
from stratapanel.llm.common import new_folder, remove_folder
from stratapanel.llm.range_coder import BLOCK_IDS, decode_block, encode_block

PAGES = "page_id long, url string, html string, path string, digest string"


def test_archive_round_trip(spark):
    long = "<p>" + "text " * 50_000
    rows = [(5, "u", "x" * 50), (2, "u\r\nX: y", "x" * 50), (3, None, None), (4, "http://é.org/a b", ""), (None, "b", ""), (6, "c", long), (2, "u\r\nX: y", "x" * 50), (None, None, "zz"), (None, None, "zz")]
    rows += [(100 + k, f"http://h{k}", f"<html>page {k} " + "shared text of all pages " * 20) for k in range(60)]
    pages = spark.createDataFrame([(*r, "p", "d") for r in rows], PAGES).repartition(3)
    folder = new_folder(spark, "test")
    manifest = warc.write_archives(pages, folder)
    found = {(r.page_id, r.payload_bytes): r for r in warc.read_archives(manifest, folder).collect()}
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows)
    for page_id, _, html in rows:
        payload = (html or "").encode()
        r = found[page_id, len(payload)]
        equal = [i for i, _, h in rows if (h or "") == (html or "") and i is not None]
        first = min(equal) if equal and page_id != min(equal) else None
        assert (r.payload_digest, r.record_type, r.refers_to) == (warc.base32_sha1(payload), "revisit" if first is not None else "response", first)
        assert r.payload == (payload if first is None else None)
    assert found[2, 50].url == "u%0D%0AX:%20y"
    assert warc.read_archives(warc.write_archives(pages.limit(0), folder), folder).count() == 0
    remove_folder(spark, folder)


def archive(records, dictionary=None, packed=False):
    out = io.BytesIO()
    if dictionary:
        content = dictionary.as_bytes()
        content = zstandard.compress(content) if packed else content
        out.write(struct.pack("<II", warc.DICTIONARY_FRAME, len(content)) + content)
    compress = zstandard.ZstdCompressor(dict_data=dictionary).compress
    for record in records:
        out.write(compress(record))
    return out.getvalue()


def read(data, tmp_path):
    path = tmp_path / "a.warc.zst"
    path.write_bytes(data)
    return list(warc.read_archive(str(path), tmp_path.as_uri()))


def test_dictionary_may_be_packed_and_is_needed(tmp_path):
    records = [warc.page_record(k, f"http://h/{k}", (f"page {k} with the same old words " * 30).encode(), None) for k in range(200)]
    dictionary = warc.learn_dictionary(records)
    assert dictionary
    for packed in (False, True):
        assert [r[0] for r in read(archive(records, dictionary, packed), tmp_path)] == list(range(200))
    content = dictionary.as_bytes()
    with pytest.raises(ValueError):
        read(archive(records, dictionary)[8 + len(content) :], tmp_path)


@pytest.mark.parametrize("change", [
    lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"), lambda r: r[:-4], lambda r: r + b"x", lambda r: r.replace(b"WARC-Date", b"Date"),
    lambda r: r.replace(b"Content-Length: 7", b"Content-Length: 8", 1), lambda r: r.replace(b"payload", b"poyload"), lambda r: r.replace(b"WARC-Type: ", b"WARC-Type "),
])
def test_invalid_records_are_refused(tmp_path, change):
    record = warc.page_record(1, "u", b"payload", None)
    assert read(archive([record]), tmp_path)[0][6] == b"payload"
    with pytest.raises(ValueError):
        read(archive([change(record)]), tmp_path)


def test_damaged_archives_are_refused(tmp_path):
    data = archive([warc.page_record(1, "u", b"payload", None)])
    for broken in (data[:-3], data[:20] + b"\0\0\0" + data[23:], struct.pack("<II", warc.DICTIONARY_FRAME, 99) + b"abc", struct.pack("<II", warc.DICTIONARY_FRAME, 4) + b"abcd"):
        with pytest.raises(ValueError):
            read(broken, tmp_path)


# Pages


@pytest.mark.parametrize(("page", "blocks", "article"), [
    ("", [], False), ("plain <b>te</b>xt &amp; &lt;more&#33; < 3", ["plain text & <more! < 3"], False), ("<p>unclosed <a href='x", ["unclosed"], False),
    ("<title>t</title><script>if (a < b) {'</p>'}</script><style>p{}</style><p>a<br>b\n c</p><!-- <p>x</p> -->d", ["a b c", "d"], False),
    ("<nav>menu</nav><header>top</header><main><article><header><h1>H</h1></header><p>one<p>two<ul><li>x<li>y</ul><aside>s</aside><div class='ad box'>buy</div><form>f</form><footer>by</footer></article>"
     "<section id=comments><article>hi</article></section></main><footer>f</footer>", ["H", "one", "two", "x", "y"], True),
    ("<div role=navigation>m</div><div class='cookie-notice'>c</div><div hidden>h</div><p>t</p><div class=sidebar><div>s</div></div><p>u", ["t", "u"], False),
    ("<article>a<script>never closed", ["a"], True), ("<p title='a>b' class=\"x\">q</p>", ["q"], False),
])
def test_blocks(page, blocks, article):
    assert html_text.page_blocks(page) == (blocks, article)


@pytest.mark.parametrize(("page", "blocks"), [
    ("<p>a <span class=ad>x</span> b</p>", ["a", "b"]), ("<p><i aria-hidden=true></i>a<p>b", ["a", "b"]), ("<p><a class=share>s<p>a<p>b", ["a", "b"]),
    ("<p>a <span hidden>x <span>y</span> z</span> b<p>c", ["a", "b", "c"]), ("<article><p>a <a class=share>s</a> b <b>c</b></p><p>d</article>", ["a", "b c", "d"]),
    ("<span itemprop=articleBody>a <span>b</span> c</span>", ["a b c"]), ("<div><span>a<div hidden>x</span>y</div>b</div>", ["a", "b"]),
])
def test_inline_noise_ends_where_its_element_ends(page, blocks):
    assert html_text.page_blocks(page)[0] == blocks


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/!-= \"'apdivnscript", max_size=80))
def test_any_markup_is_parsed(page):
    html_text.page_blocks(page)


def test_parsing_takes_linear_time():
    for page in ("<" * 200_000, "<a '" * 50_000, "<p>" * 100_000, "<!--" * 50_000, '<a b="' * 50_000):
        html_text.page_blocks(page)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=40), min_size=1, max_size=5), st.integers(2, 3))
def test_repeated_tokens_equal_brute_force(streams, least):
    tokens, pages, runs = [], [], {}
    for page, stream in enumerate(streams):
        whole = [*stream, -page - 1]
        for at in range(len(whole) - html_text.RUN + 1):
            runs.setdefault(tuple(whole[at : at + html_text.RUN]), set()).add(page)
        tokens += whole
        pages += [page] * len(whole)
    expected = np.zeros(len(tokens), bool)
    for at in range(len(tokens) - html_text.RUN + 1):
        if len(runs.get(tuple(tokens[at : at + html_text.RUN]), ())) >= least:
            expected[at : at + html_text.RUN] = True
    assert html_text.repeated_tokens(np.array(tokens), np.array(pages), least).tolist() == expected.tolist()


def test_boilerplate_of_a_host_is_removed(spark):
    furniture = "<div>Subscribe to our weekly letter and never miss a story again</div>"
    rows = [(k, f"http://host.org/{k}", f"{furniture}<p>Story {k} tells of {k * 7} things that are not told elsewhere, {k}.</p>") for k in range(200)]
    rows += [(900 + k, "http://small.org/", f"{furniture}<p>x{k}</p>") for k in range(2)]
    rows += [(950 + k, f"http://copies.org/{k}", "<article><p>the same article was printed on a few of the pages</p></article>") for k in range(5)]
    rows += [(None, None, None), (960, "no url", ""), (1, "http://host.org/1", rows[1][2])]
    out = html_text.main_text(spark.createDataFrame([(*r, "p", "d") for r in rows], PAGES)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.n_chars == len(r.text)
        if r.page_id is None or r.page_id == 960:
            assert r.text == ""
        elif r.page_id < 900:
            assert r.text == f"Story {r.page_id} tells of {r.page_id * 7} things that are not told elsewhere, {r.page_id}."
        elif r.page_id < 950:
            assert r.text.startswith("Subscribe")
        else:
            assert r.text == "the same article was printed on a few of the pages"
    assert html_text.main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_boilerplate_is_counted_over_the_whole_host(spark):
    unique = lambda k: " ".join(f"w{k}x{j}" for j in range(12))
    banner, notice = "this banner is shown on very few of the many pages here", "the notice inside of articles is shown on many of them"
    rows = [(k, f"http://wide.org/{k}", (f"<div>{banner}</div>" if k % 300 == 0 else "") + f"<p>{unique(k)}</p>") for k in range(1200)]
    rows += [(2000 + k, f"http://news.org/{k}", "<article>" + (f"<p>{notice}</p>" if k % 5 < 2 else "") + f"<p>{unique(k)}</p></article>") for k in range(300)]
    rows += [(3000 + k, f"http://few.org/{k}", f"<article><p>{notice}</p><p>{unique(k)}</p></article>") for k in range(5)]
    rows += [(4000 + k, f"http://rare.org/{k}", "<article>" + (f"<p>{notice}</p>" if k % 5 < 1 else "") + f"<p>{unique(k)}</p></article>") for k in range(300)]
    for r in html_text.main_text(spark.createDataFrame([(*r, "p", "d") for r in rows], PAGES)).collect():
        k = r.page_id % 1000 if r.page_id >= 2000 else r.page_id
        assert r.text == (f"{notice} " if r.page_id >= 4000 and k % 5 < 1 else "") + unique(k)


def test_copies_are_one_content_of_a_host(spark):
    text = "one and the same text was put on a great many pages of this host"
    rows = [(k, f"http://copies.org/{k}", f"<article><p>{text}</p></article>") for k in range(20)]
    rows += [(100 + k, f"http://loose.org/{k}", f"<p>{text}</p><!-- {k} -->") for k in range(20)]
    rows += [(7, "http://again.org/", f"<p>{text}</p>")] * 200
    out = html_text.main_text(spark.createDataFrame([(*r, "p", "d") for r in rows], PAGES)).collect()
    assert [r.text for r in out] == [text] * len(rows)


# Token ids


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=700), st.integers(301, 60_000))
def test_blocks_of_ids_round_trip(ids, vocabulary):
    assert decode_block(encode_block(np.array(ids, np.int64), vocabulary)).tolist() == ids


def test_large_blocks_round_trip_and_shrink():
    random = np.random.default_rng(2)
    even = random.integers(0, 49_408, 300_000)
    repeated = np.tile(random.integers(0, 49_408, 500), 600)
    skewed = np.minimum(random.zipf(1.3, 300_000), 49_407)
    sizes = []
    for ids in (even, repeated, skewed):
        data = encode_block(ids, 49_408)
        assert (decode_block(data) == ids).all()
        sizes.append(8 * len(data) / len(ids))
    entropy = np.bincount(skewed) / len(skewed)
    entropy = -(entropy[entropy > 0] * np.log2(entropy[entropy > 0])).sum()
    assert sizes[0] < 17 and sizes[1] < 5 and sizes[2] < entropy + 1


def test_damaged_blocks_are_refused():
    data = encode_block(np.arange(5_000), 49_408)
    for broken in (data[:-4], data[:200] + bytes([data[200] ^ 1]) + data[201:]):
        with pytest.raises(ValueError):
            decode_block(broken)


def test_token_files(spark):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [None, "", "A small text.", "### hash ## end", "long " + " ".join(f"w{k % 977}x{k}" for k in range(60_000)), "x" * 30_000, " \n ", "<|endoftext|> there"]
    rows = [(97 - 3 * k, t) for k, t in enumerate(texts)] + [(None, "no id"), (97, None), (50, "b twice"), (50, "a twice")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, start int, part int").repartition(4)
    folder = new_folder(spark, "test")
    manifest = token_ids.write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"), 2)
    out = sorted(token_ids.read_token_files(manifest, folder, ids=True).collect(), key=lambda r: r.start)
    wanted = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, (doc_id, text) in zip(out, wanted, strict=True):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (doc_id, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_ids.read_token_files(token_ids.write_token_files(docs.limit(0), folder, public_tokenizers.path("word_bpe_49k.json"), 2), folder).count() == 0
    remove_folder(spark, folder)


def test_documents_may_span_blocks(tmp_path):
    random = np.random.default_rng(4)
    docs = [(k, random.integers(0, 1000, n).astype(np.uint32)) for k, n in enumerate([3, BLOCK_IDS - 1, 5, 2 * BLOCK_IDS + 9, 1])]
    path = str(tmp_path / "a.ids")
    with pa.OSFile(path, "wb") as out:
        writer = token_ids.TokenFileWriter(out, 1000)
        for doc_id, ids in docs:
            writer.add(doc_id, ids)
        writer.close()
    with pa.OSFile(path) as data:
        back = [(i, ids.copy()) for i, _, ids in token_ids.read_token_file(data, path)]
    assert all(a == b and (x == y).all() for (a, x), (b, y) in zip(docs, back, strict=True))
    whole = open(path, "rb").read()
    open(path, "wb").write(whole[:-30] + b"?" + whole[-29:])
    with pa.OSFile(path) as data, pytest.raises(ValueError):
        list(token_ids.read_token_file(data, path))
