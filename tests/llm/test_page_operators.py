"""Pages, urls, archives and vectors against brute force and round trips."""

import base64
import gzip
import hashlib
import io
import json
import os
import random
import struct
import zipfile

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arborql.llm import components, html_text, sql, topk, url_filter, warc

PAGE = "page_id long, url string, html string, host string, path string, text string, key long"


def pages(spark, rows):
    """Pages with extra columns whose names clash with those of the operators."""
    return spark.createDataFrame([(*r, "h", "p", "t", 1) for r in rows], PAGE)


# ---------------------------------------------------------------- archives


def test_warc_round_trip(spark):
    r = random.Random(5)
    html = [None, "", "same", "same", "é" * 50_000, "same"] + [str(r.random()) * r.randrange(1, 400) for _ in range(40)]
    rows = [(i, f"http://h.com/{i}\r\nX: y" if i % 2 else None, h) for i, h in enumerate(html)]
    got = {x.page_id: x for x in warc.round_trip(pages(spark, rows).repartition(3)).collect()}
    first = {}
    for i, _, h in rows:
        first.setdefault(h or "", i)
    for i, _, h in rows:
        raw = (h or "").encode()
        o = first[h or ""]
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if o == i else ("revisit", o))
    packages = warc.write_packages(pages(spark, rows))
    back = {x.page_id: bytes(x.payload).decode() for x in warc.read_packages(packages).collect() if x.record_type == "response"}
    assert all(back[i] == h for h, i in first.items())
    assert warc.round_trip(pages(spark, rows).limit(0)).collect() == []


def test_warc_repeated_rows_and_null_ids(spark):
    rows = [(3, "u", "x"), (3, "u", "x"), (4, "u", "x"), (None, "u", "x"), (None, "u", "alone")]
    got = sorted((str(x.page_id), x.record_type, x.refers_to) for x in warc.round_trip(pages(spark, rows)).collect())
    assert got == [("3", "response", None), ("3", "response", None), ("4", "revisit", 3), ("None", "response", None), ("None", "revisit", 3)]


def test_record_ids_are_unique_and_references_hold(spark):
    rows = [(1, "http://a.com/x y?q=1", "one"), (2, None, "one"), (3, "u", "two"), (3, "u", "two"), (4, "u", "two"), (None, "u", "one"), (None, "u", ""), (5, "http://[bad", "alone")]
    got = warc.read_packages(warc.write_packages(pages(spark, rows).repartition(3))).collect()
    assert len({x.record_id for x in got}) == len(rows)
    response = {x.page_id: x.record_id for x in got if x.record_type == "response" and x.page_id != 3}
    assert {x.page_id: x.refers_to_id for x in got if x.record_type == "revisit"} == {2: response[1], None: response[1], 4: None}


def test_packages_hold_several_archives_and_a_cdxj_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_BYTES", 700)
    out = warc.PackageWriter(str(tmp_path / "p.zip"), archive_bytes=900)
    html = [f"<p>{i}" + "xyz" * (i % 7 * 40) for i in range(40)]
    for i, h in enumerate(html):
        out.add(f"http://www.Host.org/{i}", warc.digest(h.encode()), warc.record(i, f"http://www.Host.org/{i}", h.encode()))
    out.close()
    with zipfile.ZipFile(tmp_path / "p.zip") as z:
        archives = [n for n in z.namelist() if n.startswith("archive/")]
        lines = z.read(warc.INDEX).decode().splitlines()
        assert len(archives) > 3 and z.getinfo(archives[0]).compress_type == zipfile.ZIP_STORED
        key, when, told = lines[0].split(" ", 2)
        assert key.startswith("org,host,www)/") and when == "20240101000000" and lines == sorted(lines)
        told = json.loads(told)
        raw = gzip.decompress(z.read("archive/" + told["filename"])[int(told["offset"]) :][: int(told["length"])])
        assert told["url"].encode() in raw
    with open(tmp_path / "p.zip", "rb") as f:
        size = (tmp_path / "p.zip").stat().st_size
        ranges = list(warc._ranges(f, size))
        assert len(ranges) > len(archives) and sum(len(r[2]) for r in ranges) == 40
        payloads = [warc.parse(raw)["payload"].decode() for r in ranges for raw in warc._records(f, *r)]
    assert sorted(payloads) == sorted(html)


def test_packages_of_others(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_BYTES", 64)
    plain = lambda kind, mime, block, n=0: f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{kind}{n}>\r\nWARC-Target-URI: <http://x.org/{n}>\r\nContent-Type: {mime}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    page = lambda n: plain("response", "application/http; msgtype=response", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n<p>" + b"%d" % n * 90, n)
    info, image = plain("warcinfo", "application/warc-fields", b"software: other"), plain("resource", "image/png", b"\x00\r\n\r\nraw", 7)
    indexed = [gzip.compress(page(1)), gzip.compress(page(2))]
    line = lambda n, at: f'org,x)/{n} 20200101000000 {json.dumps({"filename": "archive/a.warc.gz", "offset": at, "length": len(indexed[n - 1])})}\n'
    with zipfile.ZipFile(tmp_path / "other.wacz", "w") as z:
        z.writestr("archive/a.warc.gz", b"".join(indexed))
        z.writestr("indexes/part.cdx.gz", gzip.compress(("!meta {}\n" + line(2, len(indexed[0])) + line(1, 0)).encode()))
        z.writestr("archive/b.warc", info + page(3) + image)
        z.writestr("archive/c.warc.gz", gzip.compress(page(4)) + gzip.compress(page(5) + page(6)))
        z.writestr("datapackage.json", "{}")
    rows = []
    with open(tmp_path / "other.wacz", "rb") as f:
        for r in warc._ranges(f, (tmp_path / "other.wacz").stat().st_size):
            rows += [warc._row(raw) for raw in warc._records(f, *r)]
    told = {(x[3], x[5]): x[6] for x in rows}
    assert {u for k, u in told if k == "response"} == {f"http://x.org/{n}" for n in range(1, 7)} and len(rows) == 8
    assert told["response", "http://x.org/4"] == b"<p>" + b"4" * 90 and told["resource", "http://x.org/7"] == b"\x00\r\n\r\nraw"
    listed = spark.createDataFrame([(str(tmp_path / "other.wacz"),)], "package string")
    assert warc.read_packages(listed).where("record_type = 'response' and page_id is null").count() == 6


def _zip64(names):
    """A package whose sizes and counts stand in ZIP64 fields only."""
    out, central = io.BytesIO(), b""
    for name, data in names.items():
        at, crc = out.tell(), zipfile.crc32(data)
        out.write(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0, 0, 0, 0, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name.encode() + struct.pack("<HHQQ", 1, 16, len(data), len(data)) + data)
        central += struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0, 0, 0, 0, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 28, 0, 0, 0, 0, 0xFFFFFFFF) + name.encode() + struct.pack("<HHQQQ", 1, 24, len(data), len(data), at)
    start = out.tell()
    out.write(central)
    end = out.tell()
    out.write(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, len(names), len(names), len(central), start))
    out.write(struct.pack("<IIQI", 0x07064B50, 0, end, 1))
    out.write(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
    return out.getvalue()


@pytest.mark.parametrize("prefix", [b"", b"something before"])
def test_zip64_directory(prefix):
    names = {"archive/data.warc.gz": b"records" * 10, "indexes/index.cdxj": b"{}"}
    data = prefix + _zip64(names)
    if not prefix:
        assert set(zipfile.ZipFile(io.BytesIO(data)).namelist()) == set(names)
    found = warc.members(io.BytesIO(data), len(data))
    assert {n: data[s : s + k] for n, (s, k) in found.items()} == names


def test_plain_directory_skips_packed_members():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a", b"stored")
        z.writestr(zipfile.ZipInfo("b"), b"packed" * 9, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment"
    data = buffer.getvalue()
    found = warc.members(buffer, len(data))
    assert {n: data[s : s + k] for n, (s, k) in found.items()} == {"a": b"stored"}
    with pytest.raises(ValueError):
        warc.members(io.BytesIO(b"no package"), 10)


# ---------------------------------------------------------------- urls


def brute_rank(edges, seeds):
    out = {}
    for (a, _), n in edges.items():
        out[a] = out.get(a, 0) + n
    score = {s: 0.15 for s in seeds}
    for _ in range(300):
        new = {s: 0.15 for s in seeds}
        for (a, b), n in edges.items():
            if a in score:
                new[b] = new.get(b, 0) + 0.85 * score[a] * n / out[a]
        score = new
    return score


def test_propagation_equals_brute_force(spark):
    r = random.Random(6)
    edges = {(f"h{r.randrange(9)}", f"h{r.randrange(9)}"): r.randrange(1, 5) for _ in range(25)}
    edges = {k: n for k, n in edges.items() if k[0] != k[1]}
    links = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n long")
    got = {x.host: x.score for x in url_filter.propagate(links, spark.createDataFrame([("h0",), ("h1",)], "host string")).collect()}
    want = brute_rank(edges, ["h0", "h1"])
    assert got.keys() == want.keys() and all(abs(got[h] - want[h]) < 1e-6 for h in want)


def test_url_verdicts(spark):
    link = lambda *hosts: "".join(f'<a class=x href="https://{h}/x">y</a>' for h in hosts)
    rows = [(0, "http://A.example.NET/en/1?x", ""), (1, "http://a.example.net/de/", None), (2, "x://example.com/de/1", ""), (3, "http://sub.org/fr/", ""), (4, None, ""), (5, "no scheme", ""), (6, "http://bad.net/", ""), (7, "http://farm.io/1", link("bad.net", "bad.net")), (8, "http://good.io/1", link("farm.io")), (9, "http://notnet/", ""), (10, "http://x.net", ""), (11, "http://c.io#a://b", "")]
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filter.filter_urls(pages(spark, rows)).collect()}
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1][2:] == ("net/", "block") and got[2][2:] == ("example.com/de/", "block") and got[3][2:] == ("org/fr/", "allow")
    assert got[4] == ("", "", None, "allow") and got[5] == ("", "", None, "allow") and got[6][3] == "block"
    assert got[7] == ("farm.io", "/1", None, "block")  # it links to a blocked host only
    assert got[9][2:] == (None, "allow") and got[10] == ("x.net", "", None, "allow") and got[11] == ("c.io", "", None, "allow")
    assert len(got) == len(rows) and url_filter.filter_urls(pages(spark, rows).limit(0)).collect() == []


def test_distrust_ignores_how_many_link_to_a_blocked_host(spark):
    link = lambda host, n=1: f'<a href="http://{host}/">y</a>' * n
    rows = [(0, "http://bad.net/", "")] + [(i, f"http://h{i}.io/", link("bad.net")) for i in range(1, 1001)]
    rows += [(2000, "http://half.io/", link("bad.net") + link("fine.io")), (2001, "http://portal.io/", link("bad.net") + link("fine.io", 99)), (2002, "http://fine.io/", "")]
    rows = [(i, u if i else "http://a.example.com/de/", h.replace("bad.net", "a.example.com")) for i, u, h in rows]
    got = {x.page_id: x.verdict for x in url_filter.filter_urls(pages(spark, rows)).collect()}
    assert {got[i] for i in range(1001)} == {"block"} and got[2000] == "block"
    assert got[2001] == "allow" and got[2002] == "allow"  # a hundredth of its links


def test_distrust_equals_brute_force(spark):
    r = random.Random(7)
    edges = {(f"h{a}", f"h{b}"): r.randrange(1, 5) for a, b in ((r.randrange(9), r.randrange(9)) for _ in range(25)) if a != b}
    out = {a: sum(n for (x, _), n in edges.items() if x == a) for a, _ in edges}
    want = {f"h{i}": 0.0 for i in range(9)}
    for _ in range(200):
        want = {h: 0.15 * (h == "h0") + 0.85 * sum(n / out[h] * want[b] for (a, b), n in edges.items() if a == h) for h in want}
    links = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n long")
    got = {x.host: x.score for x in url_filter.propagate(links, spark.createDataFrame([("h0",)], "host string"), against=True).collect()}
    assert got.keys() == {h for h in want if want[h]} and all(abs(got[h] - want[h]) < 1e-6 for h in got)


def test_verdicts_equal_brute_force(spark):
    r = random.Random(12)
    names = [f"h{i}.io" for i in range(14)] + ["a.org", "b.org", "x.net", "y.net"]  # org is allowed below /fr/, net blocked
    edges = {}
    for _ in range(60):
        a, b = r.choice(names), r.choice(names)
        if a != b:
            edges[a, b] = edges.get((a, b), 0) + r.randrange(1, 4)
    for a, b in (("h0.io", "h1.io"), ("h1.io", "h0.io")):  # a cycle
        edges[a, b] = 5
    out = {a: sum(n for (x, _), n in edges.items() if x == a) for a, _ in edges}
    bad, good = {"x.net", "y.net"}, {"a.org", "b.org"}
    trust, distrust = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0)
    for _ in range(400):
        trust = {h: 0.15 * (h in good) + 0.85 * sum(n / out[a] * trust[a] for (a, b), n in edges.items() if b == h) for h in names}
        distrust = {h: 0.15 * (h in bad) + 0.85 * sum(n / out[h] * distrust[b] for (a, b), n in edges.items() if a == h) for h in names}
    want = {h: h in bad or h not in good and distrust[h] >= url_filter.THRESHOLD and distrust[h] > trust[h] for h in names}
    html = lambda h: "".join(f'<a href="//{b}/">x</a>' * n for (a, b), n in edges.items() if a == h)
    rows = [(i, f"http://{h}/fr/", html(h)) for i, h in enumerate(names)]
    got = {x.host: x.verdict == "block" for x in url_filter.filter_urls(pages(spark, rows)).collect()}
    assert got == want and 4 < sum(want.values()) < 16
    db = duckdb.connect()  # the SQL of the query says the same
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert {host: verdict == "block" for _, host, _, _, verdict in db.execute(sql.URL_FILTER).fetchall()} == want


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(None, 3), (5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {x: find(x) for x in parent}


# ---------------------------------------------------------------- main text


def test_lines():
    found = html_text.lines('<nav>Menu</nav><article><header><h1>T&amp;T</h1></header><p>A&nbsp;b<br>c<div class="user-comments"><p>no</div><script>"<p>"</script><p>end</article><footer>x')
    assert [t for t, inside, _ in found if inside] == ["T&T", "A b", "c", "end"]
    assert [(t, ok) for t, inside, ok in found if not inside] == [("Menu", False), ("x", False)]
    assert [t for t, _, _ in html_text.lines("<p><b>open <i>tags<p>next &am &eacute;<!-- no")] == ["open tags", "next &am é"]


def brute_length(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14), st.sampled_from([1 << 27, 12, 0]))
def test_alignment_is_a_longest_common_subsequence(a, b, most_bits):
    got = html_text.shared(a, b, most_bits)
    assert got == sorted(set(got)) and len(got) == brute_length(a, b)
    rest = iter(b)
    assert all(any(a[i] == y for y in rest) for i in got)


def brute_texts(rows):
    """Every page against its nearest one, host by host, in plain Python. rows: page_id, url, lines (text, inside)."""
    out, hosts = {}, {}
    for page, url, own in rows:
        host, _, path = url.split("://")[1].partition("/")
        hosts.setdefault(host, []).append(("/" + path, page, own))
    for entries in hosts.values():
        entries.sort(key=lambda e: e[:2])
        runs = []
        for e in entries:  # neighbours with equal lines are one page
            if runs and runs[-1][0][2] == e[2]:
                runs[-1].append(e)
            else:
                runs.append([e])
        pages = {tuple(r[0][2]) for r in runs if r[0][2]}
        n = len(pages)
        usual = {x for p in pages for x, _ in p if n >= 5 and sum(x in {y for y, _ in q} for q in pages) >= 0.8 * n}
        prefix = lambda a, b: len(os.path.commonprefix([a, b]))
        for k, run in enumerate(runs):
            before, after = runs[k - 1] if k else None, runs[k + 1] if k + 1 < len(runs) else None
            partner = before
            if before is None or after is not None and prefix(run[-1][0], after[0][0]) > prefix(run[0][0], before[-1][0]):
                partner = after
            own, other = [x for x, _ in run[0][2]], [x for x, _ in partner[0][2]] if partner else []
            gone, j = [], 0
            for i, x in enumerate(own):  # lines are distinct and in one order in these pages
                if x in other[j:]:
                    j = other.index(x, j) + 1
                    gone.append(i)
            article = any(inside for _, inside in run[0][2])
            doubtful = sum(own[i] not in usual for i in gone)
            if article or doubtful and doubtful >= 2 / 3 * sum(x not in usual for x in own):
                gone = [i for i in gone if own[i] in usual]
            for _, page, mine in run:
                out[page] = " ".join(x for i, (x, inside) in enumerate(mine) if i not in gone and (inside or not article))
    return out


def test_main_text_equals_brute_force(spark):
    r = random.Random(11)
    rows = []
    for h in range(9):
        template = [f"t{h} {i}" for i in range(8)]
        shared_story = [f"s{h} {i}" for i in range(5)]
        for k in range(r.choice([1, 2, 4, 9, 30])):
            kind = r.random()
            body = shared_story if kind < 0.25 else [f"b{h} {k} {i}" for i in range(r.randrange(1, 5))]
            if kind > 0.85:
                body = shared_story[:3] + [f"b{h} {k}"]
            top = [(x, False) for x in template[:5] if r.random() < 0.95]
            foot = [(x, False) for x in template[6:] if r.random() < 0.95]
            inside = h % 3 == 0 or h % 3 == 1 and r.random() < 0.5
            inner = [*body, template[5]] if h % 2 else list(body)  # a line of the template may stand in the article
            rows.append((len(rows), f"http://h{h}.org/{r.choice('ab')}/{r.randrange(50):02}", top + [(x, inside) for x in inner] + foot))
    tag = lambda own: "".join(f"<article><p>{x}</p></article>" if inside else f"<p>{x}</p>" for x, inside in own)
    html = [(i, u, tag(own)) for i, u, own in rows]
    want = brute_texts(rows)
    got = {x.page_id: x.text for x in html_text.main_text(pages(spark, html).repartition(6)).collect()}
    assert got == want
    plain = {i: " ".join(x for x, inside in own if inside or not any(y for _, y in own)) for i, _, own in rows}
    assert sum(want[i] != plain[i] for i in want) > 20  # differencing decides, also in articles
    assert any(want[i] != plain[i] for i, _, own in rows if any(y for _, y in own))


def test_template_lines_go(spark):
    body = lambda t: f"<div>Home</div><div>All topics</div><p>{t}</p><p>own {t}</p><div>Imprint</div>"
    rows = [(i, f"http://h.com/a/{i:02}", body(f"text {i}")) for i in range(6)] + [(20, None, None), (21, "http://other.com/", "<p>alone</p>"), (22, "http://h.com/a/99", "<article><p>kept</p><p>Home</p></article><div>Imprint</div>")]
    rows += [(0, "http://h.com/a/00", body("text 0"))]
    got = sorted((x.page_id, x.text, x.n_chars) for x in html_text.main_text(pages(spark, rows)).collect())
    want = sorted([(i, f"text {i} own text {i}", len(f"text {i} own text {i}")) for i in [0, 0, 1, 2, 3, 4, 5]] + [(20, "", 0), (21, "alone", 5), (22, "kept", 4)])  # a usual line of the host goes from an article, too
    assert got == want
    assert html_text.main_text(pages(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("said", ['<script>var t = "<article>"</script>', "<!-- <main> -->", '<noscript><div role="main">x</div></noscript>', "<article></article>"])
def test_template_lines_go_where_article_is_only_mentioned(spark, said):
    rows = [(i, f"http://h.com/a/{i}", f"<div>Home</div>{said}<p>text {i}</p><p>own {i}</p><div>Imprint</div>") for i in range(4)]
    assert sorted((x.page_id, x.text) for x in html_text.main_text(pages(spark, rows)).collect()) == [(i, f"text {i} own {i}") for i in range(4)]


def test_copies_keep_their_text(spark):
    page = lambda *own: "<div>Home</div><div>Topics</div>" + "".join(f"<p>{x}</p>" for x in own) + "<div>Imprint</div>"
    story = [f"line {i} of the story" for i in range(8)]
    own = {f"/a/{i}": story for i in range(1, 40)}  # equal pages
    own |= {f"/b/{i}": [*story[:4], f"changed {i}", *story[5:]] for i in range(2)}  # near copies
    own |= {f"/c/{i}": [f"c {i} {k}" for k in range(3)] for i in range(20)}
    rows = [(n, f"http://h.com{p}", page(*x)) for n, (p, x) in enumerate(own.items())]
    two = [(1000 + i, f"http://two.com/{i}", page(*story)) for i in range(2)] + [(1002, "http://near.com/1", page(*story)), (1003, "http://near.com/2", page(*story[1:], "end"))]
    got = {x.page_id: x.text for x in html_text.main_text(pages(spark, rows + two).repartition(7)).collect()}
    assert [got[n] for n in range(len(rows))] == [" ".join(x) for x in own.values()]
    assert all(set(story[1:]) <= {x for x in story if x in got[n]} for n in (1000, 1001, 1002, 1003))


# ---------------------------------------------------------------- top k


def brute_top(rows, k, every):
    import math

    use = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in use if i % every == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in use if i != q and len(w) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    r = random.Random(9)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(150)]
    rows += [(i, [0.5] * 6) for i in range(200, 260)]  # many ties
    rows += [(300, None), (310, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (320, [float("nan")] * 6), (330, [float("inf")] * 6), (340, [1.0, 2.0]), (350, []), (None, [1.0] * 6), (7, [0.1] * 6)]
    df = spark.createDataFrame([(i, v, 1, "s") for i, v in rows], "vec_id long, embedding array<double>, label int, score string").repartition(4)
    got = sorted(map(tuple, topk.top_k(df, 5, 10, block=7).collect()))
    assert got == brute_top(rows, 5, 10)
    assert topk.top_k(df.limit(0)).collect() == []
    assert topk.top_k(df.where(F.col("vec_id").isin(0, 1, 2)), 10, 100).count() == 2
