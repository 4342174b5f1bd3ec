"""Derived WARC records: links, digests, files."""

import hashlib

from helixframe.llm import warc

PAGE = ("<html lang=fr><head><title>T &amp;\n x</title><style>p{}</style></head><body><p>One &lt;b&gt;</p><p>a  b"
        "<br>c</p><script>x</script></body></html>")


def pages(spark):
    return spark.createDataFrame([(1, "http://a/", PAGE, 9), (2, None, None, 9), (3, "http://b/\r\nX: y", "", 9),
                                  (1, "http://a/", PAGE, 9)], "page_id long, url string, html string, block int")


def test_links_headers_and_digests(spark):
    source = {(r.page_id, r.target_uri): r for r in warc.responses(pages(spark)).collect()}
    made = warc.derive(warc.responses(pages(spark))).collect()
    assert len(made) == 8
    for r in made:
        head = {h.name: h.value for h in r.headers}
        assert head["WARC-Refers-To"] == source[r.page_id, r.target_uri].record_id == r.refers_to
        assert head["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
        assert head["Content-Length"] == str(len(r.block.encode()))
        assert "\n" not in "".join(head.values())
    texts = {r.page_id: r.block for r in made if r.type == "conversion"}
    assert texts == {1: "One <b>\na b\nc", 2: "", 3: ""}
    fields = next(r.block for r in made if r.type == "metadata" and r.page_id == 1)
    assert "language: fr\r\n" in fields and "title: T & x\r\n" in fields
    assert "source-header: Content-Type: text/html; charset=utf-8\r\n" in fields
    assert "source-digest: sha256:" + hashlib.sha256(PAGE.encode()).hexdigest() in fields


def test_files_round_trip(spark, tmp_path):
    records = warc.responses(pages(spark)).drop("page_id")
    both = records.unionByName(warc.derive(records))
    warc.write(both, str(tmp_path / "out"))
    columns = ["type", "record_id", "target_uri", "refers_to", "block"]
    value = lambda r: tuple(r[c] or "" for c in columns)
    assert sorted(map(value, warc.read(spark, str(tmp_path / "out")).collect())) == sorted(map(value, both.collect()))


def test_empty_table(spark):
    assert warc.derive(warc.responses(pages(spark).limit(0))).count() == 0


def test_every_reference_is_decoded(spark):
    page = ("<html lang=en><head><title>A &amp; B &#8217;c&rsquo;\n&#13;&#10;X: y</title></head><body><p>&copy; x &middot; y&#8217;s "
            "&#x2019;&#X41; &amp;lt; &lt;b&gt; &CounterClockwiseContourIntegral; &nosuch; &#10;a&nbsp;b &copy2 R&D &</p></body></html>")
    rows = spark.createDataFrame([(1, "http://a/", page), (2, None, None)], "page_id long, url string, html string")
    made = {(r.page_id, r.type): r for r in warc.derive(warc.responses(rows)).collect()}
    text = "© x · y’s ’A &lt; <b> ∳ &nosuch;  a b ©2 R&D &"
    assert made[1, "conversion"].block == text and made[2, "conversion"].block == ""
    head = {h.name: h.value for h in made[1, "conversion"].headers}
    assert head["Content-Length"] == str(len(text.encode()))
    assert head["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(text.encode()).hexdigest()
    assert made[1, "metadata"].block.startswith("title: A & B ’c’ X: y\r\nlanguage: en\r\n")


def plain(page_id, url, html):
    """Both derived records of a page, spelled out."""
    import re
    from html import unescape

    uri, payload = (url or "").replace("\r", "%0D").replace("\n", "%0A"), html or ""
    sha = lambda t: "sha256:" + hashlib.sha256(t.encode()).hexdigest()

    def uuid(*parts):
        h = hashlib.sha256("\n".join(parts).encode()).hexdigest()
        return f"<urn:uuid:{h[:8]}-{h[8:12]}-8{h[13:16]}-a{h[17:20]}-{h[20:32]}>"

    def decode(t):
        return re.sub(r"&(#\d+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]{0,31});?",
                      lambda m: re.sub(r"[\t\n\f\r\xa0]", " ", unescape(m[0])), t)

    response = uuid("response", str(page_id), uri, sha(payload))
    text = re.sub(r"(?is)<(script|style|template|title)\b.*?</\1\s*>|<!--.*?-->", " ", payload)
    text = re.sub(r"[\r\n\t\f ]+", " ", text)
    names = ("address article aside blockquote body br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
             "header hr html li main nav ol p pre section table td th tr ul").replace(" ", "|")
    text = re.sub(r"<[/!?a-zA-Z][^>]*>", "", re.sub(rf"(?i)</?({names})\b[^>]*>", "\n", text))
    text = re.sub(r"[ \n]*\n[ \n]*", "\n", decode(text)).strip(" \n")
    head = re.search(r"(?is)<title[^>]*>(.*?)</title", payload)
    lang = re.search(r"(?i)<html[^>]*\blang=[\"']?([A-Za-z-]+)", payload)
    fields = "".join(line + "\r\n" for line in (
        "title: " + (re.sub(r"[\r\n\t\f ]+", " ", decode(head[1])).strip(" ") if head else ""),
        "language: " + (lang[1] if lang else ""), "source-digest: " + sha(payload), "source-header: HTTP/1.1 200 OK",
        "source-header: Content-Type: text/html; charset=utf-8", f"source-header: Content-Length: {len(payload.encode())}"))
    return [(page_id, kind, uuid(kind, response, sha(block)), response, uri, sha(payload), len(block.encode()),
             sha(block)[7:]) for kind, block in (("metadata", fields), ("conversion", text))]


def test_query_against_a_plain_version(spark):
    from helixframe.llm.q_warc import op10_warc

    sf = "/root/testdata/sf0.01"
    pages_ = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()
    want = sorted(x for r in pages_ for x in plain(*r))
    assert sorted(map(tuple, op10_warc(spark, sf).collect())) == want
    texts = [warc.plain_text(r.html) for r in pages_]
    assert not any("&copy;" in t or "&middot;" in t for t in texts) and any("©" in t for t in texts)


def test_pages_and_records_give_the_same(spark):
    key = lambda r: (r.page_id, r.type, r.record_id, r.block)
    a = sorted(warc.derive(warc.responses(pages(spark))).collect(), key=key)
    b = sorted(warc.derive_pages(pages(spark)).collect(), key=key)
    assert a == b


def test_malformed_and_hostile_pages():
    import time

    for page in ("<a <p>x</p", "<script>a<style>b</style>c", "<!-- x <p>y", "<title>t", "<html <html lang=de lang='fr'>", "a<b>c<",
                 "<html><html lang=it>", "<script>1</script ><SCRIPT>2</Script>z", "&#0;&#xD800;&notit;&lt", "<p<div>x>y"):
        got = {k[1]: k for k in plain(1, "u", page)}
        text = warc.plain_text(page)
        assert hashlib.sha256(text.encode()).hexdigest() == got["conversion"][-1], page
        fields = f"title: {warc.title(page)}\r\nlanguage: {warc.language(page)}\r\n"
        assert len(fields) > 20
    for page in ("<script " * 120_000, "<!--" * 250_000, "<a " * 350_000, "<title>" * 140_000, "<html " * 160_000, "&" * 1_000_000,
                 "<p" * 500_000, "\n " * 500_000, "&#" * 500_000, "<style></script>" * 60_000):
        began = time.process_time()
        warc.plain_text(page), warc.title(page), warc.language(page)
        assert time.process_time() - began < 8
