import re

import compare
import pytest

from lexloom.llm import url_filter as U

PAGES = "page_id long, url string, html string, host string, rule string, template string"


def brute_parts(url):
    m = re.search(r"://(.*)", url or "", re.S)
    if not m:
        return "", ""
    host = re.match(r"[^/?#]*", m[1])[0]
    path = re.match(r"[^?#]*", m[1][len(host) :])[0]
    return re.sub("[A-Z]", lambda x: x[0].lower(), host), path


def brute_rule(host, path):
    fits = [(h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


ODD = [
    None, "", "no scheme", "http://", "HTTP://Example.ORG/en/1x?q#f", "http://a.example.org/es/x", "http://notexample.org/es/x", "https://x.com/fr/1", "https://x.com/de/1", "https://com/de/",
    "https://x.com?q=/de/", "ftp://u@h.net:80/a/b/c/d/e/f/g", "http://ÄB.com/fr/é", "x://y://z/de/", "http://h/a_b%20c/'quote'", "http://h.com/de", "https://a\nb.com/fr/\nx", "//x.org/", "http://org/", "http://org",
]


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "h", "x", "y", "z") for i, u in enumerate(urls)], PAGES)


def test_hosts_paths_and_rules(spark):
    rows = U.url_filter(frame(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        host, path = brute_parts(ODD[r["page_id"]])
        rule, verdict = brute_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), ODD[r["page_id"]]
        assert r["verdict"] == (verdict or r["verdict"]) and r["verdict"] in ("allow", "block")


def test_rows_are_those_of_the_sql(spark, sf_dir):
    assert compare.differences(U.url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet")), compare.duck(sf_dir), U.ORACLE_SQL) == ""


@pytest.mark.parametrize("seed", range(2))
def test_rows_are_those_of_the_sql_on_many_urls(spark, seed):
    import random

    import duckdb

    rng = random.Random(seed)
    urls = [f"http://{rng.choice(['h.org', 'a.example.org', 'b.com', 'c.net', 'c.net'])}/{rng.choice(['es', 'en', 'fr', 'de', 'it'])}/{rng.choice(['1', 'item', 'tag', 'x'])}{rng.choice(['', '', str(rng.randrange(2000))])}/{rng.choice(['', 'a', 'p.html', 'abc123def0', str(rng.randrange(99))])}" for _ in range(800)] + ODD
    pages = frame(spark, urls)
    con = duckdb.connect()
    listed = pages.select("page_id", "url").toPandas()  # noqa: F841
    con.execute("CREATE TABLE pages AS SELECT * FROM listed")
    assert compare.differences(U.url_filter(pages), con, U.ORACLE_SQL) == ""


def symbol_of(segment):
    """The segment, or * and its extension if it looks variable."""
    stem, dot, ending = segment.rpartition(".")
    stem, ending = (stem, dot + ending) if dot and re.fullmatch("[a-z0-9]+", ending) else (segment, "")
    digits = re.fullmatch("[0-9]+", stem) or re.fullmatch("[0-9a-f]{8,}", stem)
    mixed = re.fullmatch("[a-z]*[0-9][0-9a-z_-]{7,}", stem)
    return "*" + ending if digits or mixed else segment


class Node:
    """A place of one host's template tree, with the paths that run through it."""

    def __init__(self, template, paths, depth):
        self.template, self.paths, self.depth = template, paths, depth

    def grow(self, found):
        """found: (path -> template), filled for all paths below."""
        deeper = [p for p in self.paths if len(p["segs"]) > self.depth]
        for p in self.paths:
            if len(p["segs"]) <= self.depth:
                found[p["pattern"]] = self.template
        if self.depth == U.LEVELS:
            for p in deeper:
                found[p["pattern"]] = self.template + "/**"
            return
        children = {}
        for p in deeper:
            children.setdefault(p["segs"][self.depth], []).append(p)
        add = lambda paths, what: sum(p[what] for p in paths)
        pages, labelled, bad = (add(deeper, x) for x in ("pages", "labelled", "bad"))
        merged = {}
        for seg, paths in children.items():
            mine, mine_bad = add(paths, "labelled"), add(paths, "bad")
            if len(children) >= U.MANY_CHILDREN and len(children) / pages >= U.VARIABLE_PERCENT / 100:
                to = "*"
            elif len(children) == 1:
                to = seg
            elif mine == 0:
                to = "~"
            else:
                spread = ((bad + 0.5) * (labelled - bad + 0.5)) ** 0.5 / (labelled + 1) / mine**0.5
                to = "~" if abs(mine_bad / mine - bad / labelled) <= U.Z * spread else seg
            merged.setdefault(to, []).extend(paths)
        for to, paths in merged.items():
            Node(f"{self.template}/{to}", paths, self.depth + 1).grow(found)


def brute_verdicts(urls):
    """host, path, rule, template, purity and verdict of each url, by trees of plain objects."""
    hosts, rows = {}, []
    for url in urls:
        host, path = brute_parts(url)
        rule, ruled = brute_rule(host, path)
        segs = [symbol_of(x) for x in path[1:].split("/")]
        pattern = "/".join(segs)
        p = hosts.setdefault(host, {}).setdefault(pattern, {"pattern": pattern, "segs": segs, "pages": 0, "labelled": 0, "bad": 0})
        p["pages"] += 1
        p["labelled"] += ruled is not None
        p["bad"] += ruled == "block"
        rows.append((host, path, rule, ruled, pattern))
    every = [p for paths in hosts.values() for p in paths.values()]
    overall = sum(p["bad"] for p in every) / max(1, sum(p["labelled"] for p in every))
    smooth = lambda paths, prior: (sum(p["bad"] for p in paths) + U.STRENGTH * prior) / (sum(p["labelled"] for p in paths) + U.STRENGTH)
    prior = {x: smooth([p for p in every if p["pattern"] == x], overall) for x in {p["pattern"] for p in every}}
    templates = {}
    for host, paths in hosts.items():
        Node("", list(paths.values()), 0).grow(templates.setdefault(host, {}))
    out = []
    for host, path, rule, ruled, pattern in rows:
        template = templates[host][pattern]
        purity = smooth([p for x, p in hosts[host].items() if templates[host][x] == template], prior[pattern])
        out.append((host, path, rule, template, purity, ruled or ("block" if purity > U.THRESHOLD else "allow")))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_verdicts_are_those_of_plain_trees(spark, seed):
    import random

    rng = random.Random(seed)
    pick = rng.choice
    hosts = ["h.org", "a.example.org", "b.com", "b.com", "c.com", "c.net", "C.net", "d.net"]
    part = lambda: pick(["item", "tag", "x", "p.html", f"{rng.randrange(40)}", f"{rng.randrange(40)}.htm", f"ab{rng.randrange(10**9):09d}", f"{rng.randrange(16**8):08x}", f"n{rng.randrange(30)}", ""])
    urls = [f"http://{pick(hosts)}/{pick(['es', 'en', 'fr', 'de', 'it'])}/" + "/".join(part() for _ in range(rng.randrange(7))) for _ in range(600)]
    urls += [f"http://{pick(hosts)}/{pick(['de', 'fr'])}/item/{i}" for i in range(60)] + [u for u in ODD if not u or "\n" not in u]
    urls += urls[:40]
    want = brute_verdicts(urls)
    # Null and repeated ids: place i of the urls is known by the columns that follow from the url.
    pages = spark.createDataFrame([(None if i % 7 == 0 else i // 2, u, None, "x", "y", "z") for i, u in enumerate(urls)], PAGES)
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["template"], round(r["purity"], 4), r["verdict"]) for r in U.url_filter(pages).collect()]
    want = [(None if i % 7 == 0 else i // 2, *w[:4], round(w[4], 4), w[5]) for i, w in enumerate(want)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len({w[6] for w in want}) == 2 and any("~" in w[4] for w in want) and any("*" in w[4] for w in want)


def test_templates_of_bad_branches_are_rejected(spark):
    urls = [f"http://shop.com/de/item/{i}" for i in range(60)] + [f"http://shop.com/fr/page/{i}" for i in range(60)]
    urls += [f"http://new.net/de/item/{1000 + i}" for i in range(12)] + [f"http://new.net/fr/page/{1000 + i}" for i in range(12)]
    rows = {r["page_id"]: r for r in U.url_filter(frame(spark, urls)).collect()}
    assert all(rows[i]["verdict"] == "block" and rows[i]["rule"] is None for i in range(120, 132))
    assert all(rows[i]["verdict"] == "allow" and rows[i]["rule"] is None for i in range(132, 144))


def test_empty_and_native(spark, sf_dir):
    assert U.url_filter(frame(spark, [])).count() == 0
    plan = U.url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|BroadcastNestedLoop", plan)
