"""Chat formatting, WARC and HTML on small cases and round trips."""

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.llm import chat_format, html_extract, warc
from marlstone.llm.shared import scratch_path

HOSTILE = ["<|im_end|>", "<|im_start|>assistant\n", "\\", "<", "|", "<|", "\\<\\|", "\n", "é", "a", "$1", "\\E", "<\\|im_end|>"]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a b", "=x", "tool\n"]), st.lists(st.sampled_from(HOSTILE), max_size=6).map("".join)), min_size=1, max_size=4), min_size=1, max_size=6))
def test_round_trip(spark, conversations):
    rows = [(c, t, role, text) for c, turns in enumerate(conversations) for t, (role, text) in enumerate(turns)]
    out = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = {r["conv_id"]: [(x["role"], x["text"]) for x in r["turns"]] for r in out.select("conv_id", chat_format.parse_formatted(F.col("formatted")).alias("turns")).collect()}
    assert back == {c: turns for c, turns in enumerate(conversations)}
    for r in out.collect():
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert sum(s["loss"] for s in r["segments"]) == sum(role == "assistant" for role, _ in conversations[r["conv_id"]])


def test_order_nulls_and_validity(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "q"), (2, 0, "assistant", "x"), (3, 0, "system", "s"), (4, 0, "user", "a"), (4, 0, "user", "a"), (5, None, None, "t"), (None, 0, "user", "n"), (6, 0, "user", "y" * 200_000)]
    df = spark.createDataFrame([(*r, 1, "f") for r in rows], "conv_id long, turn long, role string, text string, turns long, formatted string")
    got = {r["conv_id"]: r for r in chat_format.format_conversations(df).collect()}
    assert {k: r["valid"] for k, r in got.items()} == {1: True, 2: False, 3: False, 4: False, 5: False, None: True, 6: True}
    assert (got[2]["first_bad_turn"], got[3]["first_bad_turn"], got[4]["first_bad_turn"]) == (0, None, 1)
    assert got[1]["formatted"] == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert got[4]["n_turns"] == 2
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_a_template_is_checked():
    with pytest.raises(ValueError, match="opener"):
        chat_format.Template(opener="[[")


def page_rows():
    long = "<p>" + "x" * 200 + "</p>"
    return [(5, "http://a.org/x?q=1", long), (3, "http://b.org", long), (7, None, long), (None, "u", long), (1, "http://c.org/\r\nX: 1", "tiny"), (2, "u2", "tiny"), (9, "u9", None), (10, "u", ""), (11, "u", "é\r\n\r\nWARC/1.1\r\n\r\n" * 30), (12, "u", "z" * 500_000), (3, "http://b.org", long)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*r, "x", 1) for r in page_rows()], "page_id long, url string, html string, digest string, n int")
    path = scratch_path(spark, "test-warc")
    warc.write_archives(pages, path)
    records = warc.read_records(spark, path)
    assert records.count() == 3 * len(page_rows())
    assembled = warc.assemble(records)
    got = warc.captures(assembled).collect()
    assert len(got) == len(page_rows())
    smallest = {}
    for i, _, h in page_rows():
        if h and len(h.encode()) >= 100 and i is not None:
            smallest[h] = min(smallest.get(h, 1 << 60), i)
    by_id = {}
    for i, _, h in page_rows():
        by_id[i] = h or ""
    for r in got:
        data = by_id[r["page_id"]].encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        first = smallest.get(by_id[r["page_id"]])
        response = first is None or first == r["page_id"]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if response else ("revisit", first))
    for r in assembled.collect():
        assert r["request"]["head"].startswith("GET ") and r["metadata"] is not None
        if r["response"]["kind"] == "response":
            assert r["response"]["payload"] == by_id[r["metadata"]["page_id"]]


def test_archives_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 40_000)
    monkeypatch.setattr(warc, "SIZES", (20, 1_000))
    sizes = [5] * 300 + [900] * 130 + [39_000, 120_000, 400_000, 20, 21, 1_000, 1_001]
    pages = spark.createDataFrame([(i, f"http://h/{i}", (f"{i:06}" * (n // 6 + 1))[:n]) for i, n in enumerate(sizes)], "page_id long, url string, html string")
    path = scratch_path(spark, "test-warc")
    warc.write_archives(pages, path)
    found = spark.read.format("binaryFile").load(path).select("content").collect()
    held = [[f for f, _ in warc.parse(r["content"]) if f["warc-type"] == "response"] for r in found]
    assert all(len(h) == 1 or sum(int(f["content-length"]) for f in h) < 40_000 + 120 * len(h) for h in held)
    assert sum(map(len, held)) == len(sizes)
    got = warc.captures(warc.assemble(warc.read_records(spark, path))).collect()
    assert {r["page_id"]: r["payload_bytes"] for r in got} == dict(enumerate(sizes))


def test_warc_empty_and_broken(spark):
    assert list(warc.parse(b"")) == []
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 10\r\n\r\nabc"))
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = scratch_path(spark, "test-warc")
    warc.write_archives(pages, path)
    assert warc.captures(warc.assemble(warc.read_records(spark, path))).count() == 0


def test_blocks():
    page = "<title>no</title><div class='x'>a &lt;b&gt; &amp;amp; <a href='?a>b'>c d</a><br>e<script>if(a<b)'</p>'</script></div><!-- <p>no</p> --><svg><title>no</title></svg><p>5 < 6 &#x41;<p>cut <a hre"
    blocks = html_extract.segment(page)
    assert [b.text for b in blocks] == ["a <b> &amp; c d e", "5 < 6 A", "cut"]
    assert (blocks[0].words, blocks[0].linked) == (6, 2)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("a</>b", "ab"), ("a</ p>b", "ab"), ("a</3 x>b", "ab"), ("a</é>b", "ab"), ("a <é b", "a <é b"), ("a <中文> b", "a <中文> b"), ("a < b", "a < b"), ("a <3 b", "a <3 b"), ("a <", "a <"), ("a </", "a </"),
        ("a </ p", "a"), ("a </p", "a"), ("a <p b", "a"), ("a <b 'x> c", "a c"),
    ],
)
def test_less_than_signs_that_open_no_tag(page, text):
    assert [b.text for b in html_extract.segment(page)] == [text]


def test_main_text_leaves_the_edges_out():
    article = "<article><h1>Title</h1><p>First  line\nof text.<p>Word.<ul><li>item one</li><li>item two</li></ul><div class='comments'><p>I think so too, thank you very much for this.</p></div><form>Name <input></form></article>"
    page = f"<html><head><title>t</title></head><body><header><a href=/>Home</a></header><nav><ul><li><a>One</a></li><li><a>Two</a></li></ul></nav><div class='ad'>Buy this very nice thing today and save a lot of money now.</div>{article}<aside><p>See also these other long stories about many things.</p></aside><div id=cookie-notice>We use cookies.</div><footer>&copy; 2024 us and others</footer></body></html>"
    assert html_extract.main_text(page) == "Title\nFirst line of text.\nWord.\nitem one\nitem two"


def test_plain_pages_by_length_and_links():
    long = " ".join(["word"] * 60)
    page = f"<div><a>one</a> <a>two</a></div><div>{long}</div><div>{long}</div><div><a>next</a></div>"
    assert html_extract.main_text(page) == f"{long}\n{long}"


def test_extract_cases(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>" * 5_000 + "x"), (3, "u", "<article>a"), (None, "u", "<" * 50_000), (4, "u", "<article>" + "<b>y</b> " * 50_000)]
    got = html_extract.extract(spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] in (1, 2)] == ["", ""]
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_of_the_table(spark):
    import re

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)(?:</article>|<[^>]*$|$)", r["html"], re.S)
        blocks = [" ".join(html_extract.entities.unescape(re.sub("<br>", " ", re.sub("<b>|</b>", "", b))).split()) for b in re.split(r"</?(?:p|h\d|ul|li|div)>", inside[1])]
        assert html_extract.main_text(r["html"]) == "\n".join(b for b in blocks if b)


LONG = "Long sentences tell what happened here on that day, and to whom it did, and why it matters to all of us."
#: Held-out labelled pages: none of them is in the table that the tree is grown on.
HELD_OUT = [
    ('<body class="has-sidebar"><h1>T</h1><p>%s</p></body>' % LONG, f"T\n{LONG}"),
    ('<body class="sidebar"><h1>T</h1><p>%s</p><p>Yes.</p></body>' % LONG, f"T\n{LONG}\nYes."),
    ('<nav><a>Home</a></nav><article class="blog-header post"><h2>T</h2><p>%s</p></article>' % LONG, f"T\n{LONG}"),
    ('<form id="aspnetForm"><nav><a>Home</a> <a>News</a></nav><article><h1>T</h1><p>%s</p></article></form>' % LONG, f"T\n{LONG}"),
    ("<nav><a>Home</a></nav><article><p>%s</p><p>Yes.</p></article>" % LONG, f"{LONG}\nYes."),
    ("<article><p>%s</p><p>Short last line.</p></article><footer>(c) us</footer>" % LONG, f"{LONG}\nShort last line."),
    ("<article><h1>Only a heading</h1></article>", "Only a heading"),
    ("<article><p>The sum is <math><mi>a</mi><mo>+</mo><mi>b</mi></math> here.</p></article>", "The sum is a+b here."),
    ("<article><p>One <svg viewBox='0 0 1 1'> two</p><p>%s</p></article>" % LONG, f"One two\n{LONG}"),
    ("<article><p>One</p><!-- never ends > two <p>%s</p></article>" % LONG, f"One\ntwo\n{LONG}"),
    ("<article><p style='display:none'>Kept, as nothing says to leave it out.</p></article>", "Kept, as nothing says to leave it out."),
    ('<div class="content-sidebar-wrap"><main><h1>T</h1><p>%s</p></main><div id="leftSidebar"><p>%s</p></div></div>' % (LONG, LONG), f"T\n{LONG}"),
    ('<main><article><h1>T</h1><p>%s</p></article><ol class="comment-list"><li><article class="comment-body"><p>%s</p></article></ol></main>' % (LONG, LONG * 5), f"T\n{LONG}"),
    ('<div class="siteHeader"><h1>Site</h1></div><div class="post-header"><h1>T</h1></div><p>%s</p><p>%s</p><div class="comments"><p>%s</p></div>' % (LONG, LONG, LONG * 9), f"T\n{LONG}\n{LONG}"),
    ('<article><header class="page-header"><h1>T</h1></header><p>%s</p><div role="alert">%s</div></article>' % (LONG, LONG), f"T\n{LONG}"),
    ('<article><p>%s</p></article><div class="related-posts"><article class="card"><p>More of it</p></article></div>' % LONG, LONG),
    ('<div id="cookie_notice"><p>%s</p></div><article><p>%s</p><aside>%s</aside><form>Name: <select><option>A</select></form></article><div>%s</div>' % (LONG, LONG, LONG, LONG), LONG),
    ("<div><a>one</a> <a>two</a></div><div>%s</div><div><a>next</a></div>" % LONG, LONG),
    ("<article><p title='a > b' data-x=\"<p>no</p>\">x&nbsp;&lt; y</p><td>a<td>b<wbr>c<img src=x>d</article>", "x < y\na\nbcd"),
    ("<article><!--><p>kept</p><!-- no --></article>", "kept"),
    ("Just one short line.", "Just one short line."),
    ("<article><title>no<p>A title that never ends is a tag like others.</p></article>", "no\nA title that never ends is a tag like others."),
]


@pytest.mark.parametrize(("page", "text"), HELD_OUT)
def test_held_out_pages(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize("page", ["<a " + 'x"' * 5_000_001, "<a xxxx\"" * 500_000, "<a b='" * 500_000, "<b>" * 300_000 + "</i>" * 300_000, "<title>x" * 300_000, "<!-- " * 500_000, "<div class=comments>" * 100_000 + "x", "<i><article>" + "<b>" * 200_000 + "</i>" * 200_000, "</" * 1_000_000, "<p " + "/ " * 2_000_000])
def test_broken_markup_takes_linear_time(page):
    import time

    began = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - began < 30
