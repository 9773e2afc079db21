"""Archives and main-text extraction."""

import hashlib

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from framegrid.llm import html, warc

PAGES = "page_id long, url string, html string, text string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash") for i, u, h in rows], PAGES)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=400), max_size=40))
def test_archive_round_trip(payloads):
    records = [warc.encode_record(i, f"http://h/{i}", p, hashlib.sha256(p).hexdigest(), None) for i, p in enumerate(payloads)]
    frames = list(warc.encode_archive(records))
    blob = b"".join(f + warc.EMPTY_FRAME.encode("latin-1") for f in frames)
    back = list(warc.decode_archive(blob))
    assert [b.partition(b"\r\n\r\n")[2] for _, b in back] == payloads
    if payloads:
        assert frames[0][:4] == (0x184D2A5D).to_bytes(4, "little")
        assert len(frames) == len(payloads) + 1


def test_each_record_can_be_read_alone():
    records = [warc.encode_record(i, "http://h", b"some shared text " * 20 + str(i).encode(), "0", None) for i in range(200)]
    frames = list(warc.encode_archive(records))
    d = zstandard.ZstdCompressionDict(frames[0][8:])
    assert zstandard.ZstdDecompressor(dict_data=d).decompress(frames[117]) == records[116]
    alone = sum(len(zstandard.ZstdCompressor(level=warc.LEVEL).compress(r)) for r in records)
    assert sum(map(len, frames[1:])) < alone / 2


def test_archives_of_a_table(spark, tmp_path):
    long, other = "x" * 150, "é" * 60
    rows = [(4, "http://a/1", long), (2, "http://a/2\r\nX: y", long), (9, None, None), (7, "u", "short"), (8, "u", "short"), (1, "u", other), (3, "u", other), (5, "u", ""), (6, "u", long), (None, "u", long), (2, "again", long)]
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages(spark, rows).repartition(3), path)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[2]["record_type"] == "response" and by[4]["refers_to"] == by[6]["refers_to"] == by[None]["refers_to"] == 2
    assert (by[3]["record_type"], by[3]["refers_to"], by[1]["record_type"]) == ("revisit", 1, "response")
    assert by[7]["record_type"] == by[8]["record_type"] == by[9]["record_type"] == "response"
    texts = {i: h or "" for i, _, h in rows}
    for i, r in by.items():
        assert (r["payload_bytes"], r["payload_digest"]) == (len(texts[i].encode()), hashlib.sha256(texts[i].encode()).hexdigest())
    assert sum(r["page_id"] == 2 and r["record_type"] == "response" for r in got) == 2


def test_empty_table_and_damage(spark, tmp_path):
    path = f"file://{tmp_path}/e"
    warc.write_archives(pages(spark, []), path)
    assert warc.read_archives(spark, path).count() == 0
    frames = list(warc.encode_archive([warc.encode_record(1, "u", b"abc", "0" * 64, None)]))
    with pytest.raises(ValueError, match="dictionary"):
        list(warc.decode_archive(frames[1]))


# Extraction -------------------------------------------------------------------------------------------


def text_of(source):
    return " ".join(b.text for b in html.parse(source).blocks)


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; text", "plain & text"),
        ("<p>a<p>b<div>c</div>d", "a b c d"),
        ("<p>one <b>two</b>three<br>four</p>", "one twothree four"),
        ("<nav>menu</nav><article><h1>T</h1><p>x &lt;y&gt; &#233;&nbsp;z</p></article><footer>f</footer>", "T x <y> é z"),
        ("<script>var a='</p><p>no';</script><style>p{}</style><p>yes", "yes"),
        ("<script>never closed <p>no", ""),
        ("<!-- <p>no --><p>yes<!-- open", "yes"),
        ('<div class="ad-box">no</div><div id="cookieNotice">no</div><div class="shadow">yes</div>', "yes"),
        ('<div class="a>b">yes</div>', "yes"),
        ("<article><p>a</p><section class='comments'><article class='comment'>no</article></section></article>", "a"),
        ("<article><header><p>by me</p><h1>Title</h1></header><p>a</p></article>", "Title a"),
        ("<header>no</header><main><p>a</p><aside>no</aside></main><p>outside</p>", "a"),
        ("<form><p>no<input><p>no</form><ul><li>a<li>b</ul>", "a b"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
        ("a < b and c > d", "a < b and c > d"),
        ("<p hidden>no</p><p style='display: none'>no</p><p>yes</p>", "yes"),
        ('<main><p>Lead</p><article class="teaser">Other story</article><p>Rest</p></main>', "Lead Other story Rest"),
        ('<article><p>a</p><section id="related-work">b</section><div class="social-history">c</div></article>', "a b c"),
    ],
)
def test_parse(source, want):
    assert text_of(source) == want


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ('<div class="layout has-sidebar"><article><p>a</p></article></div>', "a"),
        ('<div class="elementor-widget-container"><p>a <b>b</b>c</p></div>', "a bc"),
        ('<div class="content ad-free"><p>a</p></div><p>much more besides</p>', "a much more besides"),
        ('<div id="page-with-menu"><p>a</p></div><p>much more besides</p>', "a much more besides"),
        ('<div class="sidebar"><div class="ad">no</div><article><p>a</p></article></div>', "a"),
        ('<div class="widget"><main>un<b>believ</b>able</main></div><p>much more besides</p>', "unbelievable"),
        ('<div id="overlay"><p>most of the text</p></div><p>yes</p>', "most of the text yes"),
        ('<article class="post has-comments">a</article>', "a"),
        ('<article><p>a</p></article><div class="related-posts"><article>no</article></div>', "a"),
        ('<div class="related"><article><p>a</p></article></div><p>outside</p>', "a"),
        ('<p>post</p><div id="comments">no, and at more length</div>', "post"),
        ('<div class="site-footer">no</div><div class="ad-300x250">no</div><p>yes, it is</p>', "yes, it is"),
    ],
)
def test_names_drop_no_wrapper_of_the_article(source, want):
    assert text_of(source) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("<>/p a\"'=!-divbuartcle&;")), max_size=80))
def test_parse_takes_any_text(source):
    text_of(source)


def test_template_of_a_site_goes_and_quoted_passages_stay(spark):
    rows = []
    for i in range(12):
        banner = "<div><p>Welcome to our site</p></div>" if i != 3 else ""
        rows.append((i, f"http://Host.example/{i}", f"<body>{banner}<div><p>unique {i}</p></div></body>"))
    for i in range(20, 40):
        rows.append((i, f"http://b.example/{i}", f"<article><p>quoted by all</p><p>own {i}</p><div>Share this</div></article>"))
    for i in range(50, 60):  # copies of one page are one page
        rows.append((i, "http://c.example/x", "<body><div>the same text</div></body>"))
    rows += [(70, None, None), (71, "nonsense", "<p>x</p>"), (None, "http://d/", "<p>y</p>"), (0, "http://Host.example/0", rows[0][2])]
    got = html.extract(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r["text"] for r in got}
    assert all(by[i] == f"unique {i}" for i in range(12))
    assert all(by[i] == f"quoted by all own {i}" for i in range(20, 40))
    assert all(by[i] == "the same text" for i in range(50, 60))
    assert (by[70], by[71], by[None]) == ("", "x", "y")
    assert html.extract(pages(spark, [])).count() == 0


def test_notices_in_main_and_list_items_on_nearly_all_pages_go(spark):
    rows = [(i, f"http://a.example/{i}", f"<main><p>notice</p><p>own {i}</p><ul><li>item<li>mine {i}</ul></main>") for i in range(12)]
    for i in range(20, 32):
        often = "<p>quoted</p>" if i < 28 else ""
        rows.append((i, f"http://b.example/{i}", f"<main>{often}<p>own {i}</p></main>"))
    for i in range(40, 52):
        rows.append((i, f"http://c.example/{i}", f"<article><p>quoted</p><ul><li>item<li>mine {i}</ul></article>"))
    by = {r["page_id"]: r["text"] for r in html.extract(pages(spark, rows)).collect()}
    assert all(by[i] == f"own {i} mine {i}" for i in range(12))
    assert all(by[i] == ("quoted " if i < 28 else "") + f"own {i}" for i in range(20, 32))
    assert all(by[i] == f"quoted mine {i}" for i in range(40, 52))


def brute_extraction(rows, min_pages=5, inner=0.3, leaf=0.9):
    """Main texts by counting subtrees in plain Python, page by page."""
    parsed = [html.parse(h, html_host(u)) for _, u, h in rows]
    hosts: dict = {}
    for (_, u, _), p in zip(rows, parsed, strict=True):
        body = tuple(b.text for b in p.blocks)
        hosts.setdefault(html_host(u), {}).setdefault(body, set()).update(p.subtrees)
    out = []
    for (i, u, _), p in zip(rows, parsed, strict=True):
        pages = hosts[html_host(u)].values()
        n = {h: sum(h in own for own in pages) for h in p.subtrees}
        often = {h for h, k in n.items() if k >= min_pages and (not h & 1 or k >= (leaf if h & 2 else inner) * len(pages))}
        blocks, gone = p.main_text(often)
        out.append((i, " ".join(b.text for b in blocks), gone))
    return sorted(out, key=str)


def html_host(url):
    import re

    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def site(rng, host, n):
    bits = ["<div class='teaser'>Read more from us</div>", "<nav><a>Home</a></nav>", "<p>Our promise</p>", "<ul><li>Shop</li><li>About</li></ul>", "<footer>Imprint</footer>", "<section><p>All rights</p></section>"]
    for k in range(n):
        around = "".join(x for x in bits if rng.random() < 0.6)
        inner = "".join(x for x in bits[2:4] if rng.random() < 0.5)
        kind = rng.choice(["article", "main", "div"])
        yield f"http://{host}/{k}", f"<body>{around}<{kind}><h1>T{k}</h1><p>{host} own {k % 7}</p>{inner}</{kind}><div>{rng.choice('abc')}</div></body>"


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_template_removal_equals_brute_force_over_hosts(spark, broadcast):
    """Also where the template's hashes are too many for the workers and are joined to their pages."""
    import random

    rng = random.Random(6)
    rows = [(k, u, h) for k, (u, h) in enumerate([*site(rng, "a.example", 30), *site(rng, "b.example", 14), *site(rng, "c.example", 3)])]
    rows += [(None, "http://a.example/x", rows[0][2]), (None, "http://b.example/x", rows[31][2]), (3, rows[40][1], rows[40][2]), (50, None, None), rows[5]]
    got = html.extract(pages(spark, rows), broadcast_subtrees=broadcast).collect()
    assert sorted(((r["page_id"], r["text"], r["n_removed"]) for r in got), key=str) == brute_extraction(rows)
    assert sum(r["n_removed"] for r in got) > len(rows)
    assert any("Our promise" not in r["text"] and "Read more" not in r["text"] for r in got)


def test_a_very_long_page_is_read_whole(spark):
    words = " ".join(f"w{i}" for i in range(200_000))
    got = html.extract(pages(spark, [(1, "http://a/", f"<article><p>{words}</p></article>")])).first()
    assert got["text"] == words
