"""Operators on pages: archives and main text."""

import hashlib
import random
import time
import uuid

import pytest

from arborel.llm import common, warc, wrapper


def pages(spark):
    rng = random.Random(1)
    big = ["<p>" + "x" * n + "</p>é" for n in (1000, 2000, 992, 993)]
    rows = [(i, f"http://h{i % 3}.example/p?{i}", rng.choice([*big, "small", "small", None, "", f"own {i}" * 200])) for i in range(60)]
    rows += [(100, "u\r\nInjected: yes", big[0]), (None, None, big[0]), (None, "x", "only" * 400), (101, "y", "twice" * 300), (101, "y", "twice" * 300)]
    return rows, spark.createDataFrame([(i, u, h, 1, "z") for i, u, h in rows], "page_id long, url string, html string, size int, digest string").repartition(4)


@pytest.mark.parametrize("few", [200_000, 0])
def test_archive_against_brute_force(spark, few):
    rows, frame = pages(spark)
    newest = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            newest[h] = max(newest.get(h, i), i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        other = newest.get(h) if len(raw) >= 1000 and newest.get(h) != i else None
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if other is None else "revisit", other))
    got = warc.archived(frame, roll=3000, shards=3, most_broadcast=few).drop("url", "file").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_archives_are_deterministic_and_roll(spark):
    _, frame = pages(spark)
    made = []
    for parts in (1, 5):
        path = common.new_path(spark, "warc")
        manifest = warc.write_warc(frame.repartition(parts), path, roll=2000, shards=2)
        assert len(manifest["files"]) > 3 and manifest["records"] == frame.count()
        fs, place = warc.store(path)
        files = {f["name"]: fs.open_input_stream(f"{place}/{f['name']}", compression=None).read() for f in manifest["files"]}
        assert not [f for f in fs.get_file_info(warc.pa.fs.FileSelector(place)) if f.path.endswith(".tmp")]
        made.append(files)
        payloads = {r.page_id: r.payload for r in warc.read_warc(spark, path).where("record_type = 'response'").collect()}
        assert payloads[100].decode() == "<p>" + "x" * 1000 + "</p>é"
    # Ranges follow from the counts of all ids, whatever the partitions of the input.
    assert made[0] == made[1]


def test_damage_is_an_error(spark):
    data = warc.record(1, "u", 3, hashlib.sha1(b"abc").hexdigest(), None, b"abc", "1970-01-01T00:00:00Z")
    (whole,) = warc.members(__import__("io").BytesIO(data))
    headers, block = warc.parse(whole)
    assert block.endswith(b"abc") and headers["WARC-Record-ID"] == f"<{uuid.UUID(headers['WARC-Record-ID'][10:-1]).urn}>"
    with pytest.raises(ValueError, match="digest"):
        warc.parse(whole.replace(b"abc\r\n\r\n", b"abd\r\n\r\n"))
    with pytest.raises(ValueError, match="ends"):
        list(warc.members(__import__("io").BytesIO(data[:-5])))


def test_empty_archive(spark):
    _, frame = pages(spark)
    assert warc.archived(frame.where("false")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>
<article><header><h1>Title &amp;
  more</h1><p>By no one</p></header><p><b>First&nbsp;line.<br>Second<p>Third <a href="x">link</a> &lt;b&gt; &#233;</p>
<ul><li>one<li>two</ul><aside>aside</aside><form><input><label>Mail</label></form>
<table><tr><td>cell<td>next</table><noscript>no</noscript><section id="comments"><p>Nice!</p></section></article>
<footer>&copy; foot</footer></body></html>"""


def test_article():
    found = wrapper.blocks(PAGE)
    text = wrapper.main_text(found, "", frozenset(), ())
    assert text.split("\n") == ["Title & more", "First line. Second", "Third link <b> é", "one", "two", "cell", "next"]


@pytest.mark.parametrize("page", ["", "plain", "<p>", "<p", "<script>x", "</div></p>", "<article>", "<a<b>c", "<p>a</b>c</p>"])
def test_broken_pages(page):
    assert isinstance(wrapper.main_text(wrapper.blocks(page), "", frozenset(), ()), str)


def test_tree_matching():
    a = wrapper.folded([("body", "div", "p"), ("body", "ul", "li"), ("body", "div.x", "p")])
    b = wrapper.folded([("body", "section", "p"), ("body", "div", "p"), ("body", "div.x", "h1")])
    weight, _ = wrapper.matched(a[1][0], b[1][0])
    assert weight == 2 + (2 + 2) + 2  # body; div with p; div.x
    found = wrapper.slots(a, (b,))
    assert found[("body", "div", "p")] == "0/body/div/p" and found[("body", "ul", "li")] == "0/body/+ul/+li"
    assert wrapper.slots(a, (b, a))[("body", "ul", "li")] == "1/body/ul/li" and wrapper.slots(a, ())[("body",)] == "/+body"
    assert wrapper.decoded(wrapper.encoded(a)) == a


@pytest.mark.parametrize("few", [32 << 20, 0])
def test_constant_slots_are_template(spark, few):
    """Without an article or telling names, what repeats over a host's pages goes."""
    rows = [(i, f"http://a.example/{i}", f"<body><div><p>Welcome to the site</p></div><div class=main><h2>Story {i}</h2><p>Words {i * 7} here</p></div><div><p>All rights reserved</p></div></body>") for i in range(40)]
    rows += [(100, "http://b.example/x", "<body><p>Alone</p></body>"), (101, None, None), (102, "nonsense", ""), (0, "http://a.example/0", rows[0][2])]
    frame = spark.createDataFrame([(*r, "c", "d") for r in rows], "page_id long, url string, html string, host string, text string").repartition(3)
    got = sorted(wrapper.extract(frame, most_broadcast=few).collect(), key=repr)
    want = [(i, u, f"Story {i}\nWords {i * 7} here") for i, u, _ in rows[:40]] + [(100, "http://b.example/x", "Alone"), (101, None, ""), (102, "nonsense", ""), (0, "http://a.example/0", "Story 0\nWords 0 here")]
    assert [tuple(r) for r in got] == sorted([(i, u, t, len(t)) for i, u, t in want], key=lambda r: f"Row(page_id={r[0]!r}, url={r[1]!r}, text={r[2]!r}, n_chars={r[3]!r})")
    assert wrapper.extract(frame.where("false")).count() == 0


def test_constant_slots_of_articles_are_template(spark):
    """Statistics decide within articles too; an article that is constant as a whole stays."""
    rows = [(i, f"http://a.example/{i}", f"<body><article><h1>Story {i}</h1><p>Words {i * 7} here</p><div class=x>Tell your friends</div></article><div>{i} seen</div></body>") for i in range(20)]
    rows += [(100 + i, f"http://b.example/{i}", f"<body><article><p>The only text</p></article><div>{i} seen</div></body>") for i in range(20)]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i}\nWords {i * 7} here" for i in range(20)} | {100 + i: "The only text" for i in range(20)}


def test_hosts_of_several_templates(spark):
    """Each page goes with the exemplar that it is most like, so that no template's slots blur another's."""
    rows, want = [], {}
    for i in range(60):
        said = f"Words {i * 7} here"
        if i % 3:
            rows.append((i, f"http://a.example/{i}", f"<body><ul><li>Start</li></ul><div class=p{i}><h2>News {i}</h2><p>{said}</p></div><div class=q{i}><p>All rights reserved</p></div></body>"))
        else:
            rows.append((i, f"http://a.example/{i}", f"<body><div class=p{i}><p>Our shop</p></div><table><tr><td>News {i}</td></tr></table><div class=q{i}><p>{said}</p></div></body>"))
        want[i] = f"News {i}\n{said}"
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == want


def test_copies_of_a_page_count_once(spark):
    """Neither copies of one page nor a host of much copied pages make content look constant."""
    rows = [(i, f"http://a.example/{i}", "<body><p>Copied</p></body>") for i in range(8)]
    rows += [(100 + i, f"http://b.example/{i}", f"<body><h2>Welcome</h2><p>Story {i // 6}</p></body>") for i in range(60)]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "Copied" for i in range(8)} | {100 + i: f"Story {i // 6}" for i in range(60)}


def test_links_and_like_names_are_text():
    """Link paragraphs stay, and so do parts whose names only hold a word of the list."""
    page = """<body><article><h2 id="related-work">Related</h2><section id="search-algorithms"><p>Search</p></section><section id="notice"><p>Note</p></section>
<h3 id="share">Share</h3><div class="share-prices">Prices</div><div class="share-buttons">Tweet</div><div class="main social-links">Follow</div><div class="ad-300x250">Buy</div></article></body>"""
    assert wrapper.main_text(wrapper.blocks(page), "", frozenset(), ()).split("\n") == ["Related", "Search", "Note", "Share", "Prices"]
    page = '<body><h2><a href="/s">Story</a></h2><p>Said</p><ul><li><a href="/r">Reference one</a></ul><div id="comments">Nice</div></body>'
    assert wrapper.main_text(wrapper.blocks(page), "", frozenset(), ()).split("\n") == ["Story", "Said", "Reference one"]


def test_induction_against_brute_force(spark):
    """200 pages of ten hosts: what every page of a host repeats in one place is template, inside articles too, and all else is text."""
    rng = random.Random(12)
    words = lambda n: " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randrange(10_000)) for _ in range(n))
    rows, want = [], {}
    for h in range(10):
        lead, share, foot, inside, wrap = words(6), words(4), words(5), h % 2 == 0, rng.choice(["div", "section"])
        tag = rng.choice(["article", "main", "div"])
        for k in range(20):
            title, body = words(3), [words(rng.randrange(3, 30)) for _ in range(rng.randrange(1, 6))]
            own = [title, *body]
            parts = [f"<p>{b}</p>" for b in body]
            if inside:  # constant paragraphs among the article's own, in the same slot
                parts.insert(rng.randrange(len(parts) + 1), f"<p>{share}</p>")
            page = f"<html><body><div class=x{k}><p>{lead}</p></div><{wrap} class='c{k % 3}'><{tag}><h2>{title}</h2>{''.join(parts)}</{tag}></{wrap}><div><span>{foot}</span></div></body></html>"
            rows.append((h * 100 + k, f"https://host{h}.example/{k}", page))
            want[h * 100 + k] = "\n".join(own)
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert got == want


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after", "deep\nafter"),
        ("<b><div>" * 20_000 + "deep", "deep"),
        ("said <a " * 100_000, "said"),
        ("x" + "<i>" * 100_000 + "</b>" * 100_000 + "y", "xy"),
        ("<p>x" + "<!" * 300_000, "x"),
        ("<p>x" + "<a \"x>y\" b='" * 50_000 + "\"", "x"),
        ("<p>x<script>" + "</script " * 100_000, "x"),
        ("<p>x<svg>" * 50_000, "x"),
        ("<p>a<i title='>'>b</i> <b title=\"it's\">c</b><u title='\">d</u>'>e", "ab ce"),
        ("".join(f"<p class=c{i}>w{i}</p>" for i in range(3000)), "\n".join(f"w{i}" for i in range(3000))),
    ],
    ids=["deep", "deep fences", "unclosed tags", "unmatched ends", "declarations", "quotes", "script", "svg", "quoted", "wide"],
)
def test_hard_pages_are_read_in_seconds(page, text):
    began = time.time()
    found = wrapper.blocks(page)
    tree = wrapper.folded([b.path for b in found])
    twin = wrapper.decoded(wrapper.encoded(wrapper.folded([b.path for b in wrapper.blocks(page + "<h1>x</h1>")])))
    assert wrapper.main_text(found, "h", frozenset(), (twin,)) == text
    assert wrapper.matched(tree, twin)[0] > 0 and time.time() - began < 10


def test_outer_blocks_tell_slots_apart():
    found = wrapper.blocks("<div>" * (wrapper.LEVELS + 5) + "<p>a</p><h2>b</h2>")
    assert len(found) == 2 and found[0].path == found[1].path and len(found[0].path) == wrapper.LEVELS
