"""URL filters against plain loops, and against their SQL on a small web with links."""

import re

import duckdb
import pytest

from barscreen.llm import oracle, urls

RULES = [
    urls.parse_rule(r)
    for r in ("block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/", "allow good.com/", "block www.good.com/x")
]


def anchor(*targets):
    return "<html>" + "".join(f'<a class="x" href="{t}">y</a>' for t in targets) + "</html>"


PAGES = [
    (1, "https://Good.com/a?x#y", anchor("http://friend.com/1", "//Friend.com/2", "/local", "https://far.com?x")),
    (2, "http://good.com/b", anchor("http://friend.com/")),
    (3, "http://www.good.com/x1", None),
    (4, "http://bad.net/", anchor("http://victim.com/")),
    (5, "http://fan.com/", anchor("http://bad.net/q", "http://worse.net")),
    (6, "http://fan2.com/p", anchor("http://fan.com/", "http://friend.com")),
    (7, "http://friend.com", anchor("http://fan.com/", "http://next.com/")),
    (8, "http://next.com?q=http://bad.net/", ""),
    (9, "http://victim.com#top", anchor("http://bad.net/")),
    (10, "http://example.net/en/1", ""),
    (11, "http://a.example.net/en", ""),
    (12, "http://notnet/", ""),
    (13, "http://net/", ""),
    (14, "http://x.net", ""),
    (15, "http://B.example.com/de/", ""),
    (16, "http://b.example.com/de", ""),
    (17, "x.org/fr/", ""),
    (18, None, anchor("http://bad.net/")),
    (19, "", None),
    (20, "ftp://É.ORG/fr/é?", ""),
    (21, "http:///fr/", ""),
    (None, "http://fan.com/", None),
    (1, "https://Good.com/a?x#y", anchor("http://friend.com/1")),
    (22, "http://" + "long." * 3000 + "net/" + "p" * 20000, "<a href=//bad.net>" * 3000),
]


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(raw):]).group()
    return raw.translate(str.maketrans(urls.UPPER, urls.LOWER)), path


def brute(pages, rules, rounds=20, damping=0.85, least=0.01):
    found, linked, counts = [], {}, {}
    for page, url, html in pages:
        host, path = parts(url)
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fit, key=lambda r: len(r.host + r.path), default=None)
        found.append((page, host, path, rule))
        if not host:
            continue
        count = counts.setdefault(host, [0, 0, 0])
        count[0] += 1
        if rule:
            count[1 if rule.verdict == "allow" else 2] += 1
        for dst in {t.lower() for t in re.findall(urls.LINK, html or "")} - {host}:
            linked[host, dst] = linked.get((host, dst), 0) + 1
    masses = []
    for which, ends in ((1, linked), (2, {(b, a): n for (a, b), n in linked.items()})):
        term = {h: urls.SEED for h, c in counts.items() if 2 * c[which] > c[0]}
        mass = dict(term)
        for _ in range(rounds):
            after = {}
            for (a, b), n in ends.items():
                total = sum(m for (x, _), m in ends.items() if x == a)
                if a in term:
                    after[b] = after.get(b, 0) + int(term[a] * damping * (n / total))
            term = {h: m for h, m in after.items() if m}
            for h, m in term.items():
                mass[h] = mass.get(h, 0) + m
        masses.append(mass)
    out = []
    for page, host, path, rule in found:
        trust, distrust = (m.get(host, 0) for m in masses)
        own = "block" if distrust >= least * urls.SEED and distrust > trust else "allow"
        out.append((page, host, path, rule and rule.host + rule.path, rule.verdict if rule else own, trust, distrust))
    return sorted(out, key=str)


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(5)


def test_equals_loops_and_sql(spark, pages):
    want = brute(PAGES, RULES)
    got = urls.filtered(pages, RULES)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "trust", "distrust"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == want
    by_page = {r[0]: r for r in want}
    assert by_page[5][4] == "block" and by_page[8][4] == "allow" and by_page[18][4] == "allow"
    assert {r[4] for r in want if r[1] == "friend.com"} == {"allow"}
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", PAGES)
    assert sorted(con.execute(oracle.url_filters(RULES)).fetchall(), key=str) == want


def test_empty_and_extra_columns(spark, pages):
    assert urls.filtered(pages.limit(0), RULES).count() == 0
    extra = pages.selectExpr("*", "1 as host", "'x' as path", "0 as rule", "2 as mass", "page_id as kind")
    got = sorted([tuple(r) for r in urls.filtered(extra, RULES).collect()], key=str)
    assert got == brute(PAGES, RULES)


def test_without_rules_all_is_allowed(spark, pages):
    assert {r.verdict for r in urls.filtered(pages, []).collect()} == {"allow"}


def test_main_path_has_no_python(pages):
    plan = urls.filtered(pages, RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("text", ["net/", "deny net/", "block net", "block /x"])
def test_rules_are_checked(text):
    with pytest.raises(ValueError):
        urls.parse_rule(text)
