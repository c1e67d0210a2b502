from __future__ import annotations

import math
import random
import re

import pytest

from llm_fixtures import documents, shipped  # noqa: F401
from cliplake.llm import urls as U


def verdicts(spark, rows, labels=(), **how):
    pages = spark.createDataFrame([(i, u, "x", "clash") for i, u in rows], "page_id bigint, url string, host string, template string")
    marks = spark.createDataFrame(list(labels), "doc_id bigint, quality int")
    return sorted((tuple(r) for r in U.judge_urls(pages, marks, **how).collect()), key=repr)


def test_hosts_paths_and_rules(spark):
    cases = {
        "http://WWW.Example.COM/en/x?q#f": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "http://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
        "http://example.com/en": ("example.com", "/en", "com/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "https://x.net/fr/1#y": ("x.net", "/fr/1", "net/fr/", "block"),
        "https://x.net?fr/": ("x.net", "", None, "allow"),
        "https://x.com": ("x.com", "", None, "allow"),
        "ftp://h/a://b": ("h", "/a://b", None, "allow"),
        "no scheme/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://ÄB.org/\n?": ("Äb.org", "/\n", None, "allow"),
    }
    got = verdicts(spark, list(enumerate(cases)))
    assert {r[0]: r[1:5] for r in got} == dict(enumerate(cases.values()))
    assert verdicts(spark, []) == []


def test_variable_segments_become_wildcards(spark):
    rows = [(i, f"http://h.org/item/{i}/view") for i in range(40)] + [(100 + i, f"http://h.org/{n}/x") for i, n in enumerate(["about", "help"])]
    rows += [(200 + i, f"http://h.org/u/{w}") for i, w in enumerate("ant bee cat dog elk fox gnu hen ibis jay".split())] + [(300, "http://h.org/*/#")]
    got = {r[0]: r[5] for r in verdicts(spark, rows)}
    assert {got[i] for i in range(40)} == {"/item/#/view"} and got[100] == "/about/x" and {got[200 + i] for i in range(10)} == {"/u/*"}
    assert got[300] == "/\\*/"
    deep = "/".join(f"d{i % 3}" for i in range(500))
    assert len(verdicts(spark, [(1, "http://h.org/" + deep), (2, "http://h.org/" + deep), (2, "http://h.org/a")])) == 3


def test_purity_rejects_bad_branches(spark):
    rng = random.Random(1)
    rows = [(i, f"http://h.org/{'spam' if i % 3 == 0 else 'news' if i % 3 == 1 else 'blog'}/{i}") for i in range(300)]
    labels = [(i, int(i % 3 != 0 and rng.random() < 0.95)) for i in range(0, 300, 2)] + [(None, 0), (4, None), (6, 1)]
    got = verdicts(spark, rows + [(3, rows[3][1])], labels)
    assert {r[4] for r in got if "/spam/" in r[2]} == {"block"} and {r[4] for r in got if "/spam/" not in r[2]} == {"allow"}
    assert len(got) == 301


def test_similar_branches_are_merged(spark):
    rows = [("h", "/p", f"/p/{b}", int(i % 5 != 0)) for b in "abcd" for i in range(20)] + [("h", "/p", "/p/bad", 0)] * 30
    rows += [("h", "/p", "/p/new", None)]
    df = spark.createDataFrame(rows, "host string, parent string, template string, good int")
    got = {r.template: (r.branch, r.rejected) for r in U.judged_templates(df).collect()}
    assert got["/p/bad"] == ("/p/bad", True) and got["/p/new"] == ("/p/~", False)


def test_more_pages_or_repeated_rows_keep_templates_and_verdicts(spark):
    # numbers repeat 11 times: '#' good, '#.html' bad; 30 users with many posts each, few sections
    few = [(i, f"http://h.org/en/{i}{'.html' if i % 2 else ''}") for i in range(2_000)]
    few += [(10_000 + i, f"http://h.org/{w}{x}/2024-01-{i:02d}/p") for i, (w, x) in enumerate((a, b) for a in "abcdef" for b in "vwxyz")]
    labels = [(i, int(i % 2 == 0)) for i in range(0, 2_000, 7)]
    once = verdicts(spark, few, labels)
    by = {r[0]: r for r in once}
    assert by[0][5] == "/en/#" and by[0][4] == "allow" and by[1][5] == "/en/#.html" and by[1][4] == "block"
    assert by[10_003][5] == "/*/#-#-#/p"
    assert verdicts(spark, few * 10, labels) == sorted(once * 10, key=repr)
    more = few + [(20_000 + i, f"http://h.org/en/{i % 9_000}{'.html' if i % 2 else ''}") for i in range(100_000)]
    more += [(200_000 + i, f"http://h.org/{a}{b}/2023-{i:03d}-01/p") for i in range(40) for a in "abcdef" for b in "vwxyz"]
    got = {r[0]: r for r in verdicts(spark, more, labels)}
    assert all((got[i][4], got[i][5]) == (by[i][4], by[i][5]) for i in by)
    assert {(got[20_000 + i][4], got[20_000 + i][5]) for i in range(100_000)} == {("allow", "/en/#"), ("block", "/en/#.html")}


def test_little_evidence_is_not_multiplied_by_repeated_rows(spark):
    rows = [(i, f"http://h.org/{'a' if i < 6 else 'b'}/x{'y' * i}") for i in range(12)]
    labels = [(i, int(i not in (0, 1, 2, 7))) for i in range(12)]
    once = verdicts(spark, rows, labels)
    assert verdicts(spark, rows * 10, labels) == sorted(once * 10, key=repr)


def apart(n, good, all_n, all_good, z):
    rest = all_n - n
    if not n or not rest:
        return False
    p = all_good / all_n
    return abs(good / n - (all_good - good) / rest) > z * math.sqrt(p * (1 - p) * (1 / n + 1 / rest))


def tree_of(pages, quality, variety=10):
    """{(host, path): (template, verdict)} by walking the tree in loops."""
    cut = lambda u: re.match(r".*?://([^/?#]*)([^?#]*)", u).groups()
    marked = {}
    for page, url in pages:
        marked.setdefault(cut(url), set())
        if page in quality:
            marked[cut(url)].add(page)
    rows = [{"h": h, "p": p, "s": p.split("/")[1:], "n": len(m), "g": sum(quality[x] for x in m), "t": "", "b": "", "up": ""} for (h, p), m in marked.items()]
    total = lambda xs: (sum(x["n"] for x in xs), sum(x["g"] for x in xs))

    def by(xs, *keys):
        out = {}
        for x in xs:
            out.setdefault(tuple(x[k] for k in keys), []).append(x)
        return out

    for at in range(max(len(r["s"]) for r in rows)):
        going = [r for r in rows if len(r["s"]) > at]
        for r in going:
            x = r["x"] = r["s"][at]
            r["l"] = re.sub("[0-9]+", "#", x) if re.search("[0-9]", x) else re.sub(r"([*#~\\])", r"\\\1", x)
        for place in by([r for r in going if r["x"] and not re.search("[0-9]", r["x"])], "h", "t").values():
            names = by(place, "x")
            told = sum(total(v)[0] >= U.ENOUGH for v in names.values())
            z = math.sqrt(2 * math.log(max(told, 1) / U.CHANCE))
            rare = [v for v in names.values() if len(v) * variety <= 2 * len(place)]
            if len(rare) >= variety:
                for v in rare:
                    if not (total(v)[0] >= U.ENOUGH and apart(*total(v), *total(place), z)):
                        for r in v:
                            r["l"] = "*"
        for family in by(going, "h", "b").values():
            whole = total(family)
            for kids in by(family, "l").values():
                own = apart(*total(kids), *whole, 1.96)
                for r in kids:
                    r["up"], r["b"], r["t"] = r["b"], r["b"] + "/" + (r["l"] if own else "~"), r["t"] + "/" + r["l"]
    every = total(rows)
    prior = (every[1] + 1) / (every[0] + 2)
    for host in by(rows, "h").values():
        hn, hg = total(host)
        for family in by(host, "up").values():
            for leaf in by(family, "t").values():
                for r in leaf:
                    r["branch"] = r["t"] if apart(*total(leaf), *total(family), 1.96) else r["up"] + "/~"
        for branch in by(host, "branch").values():
            bn, bg = total(branch)
            smooth = (bg + 5 * (hg + 5 * prior) / (hn + 5)) / (bn + 5)
            for r in branch:
                r["v"] = "block" if smooth < 0.5 else "allow"
    return {(r["h"], r["p"]): (r["t"], r["v"]) for r in rows}


@pytest.mark.parametrize("seed", range(2))
def test_tree_against_loops(spark, seed):
    rng = random.Random(seed)
    names = ["news", "blog", "spam", "shop", "*", "a~b", ""] + [f"n{chr(97 + i // 5)}{chr(97 + i % 5)}" for i in range(25)]
    pages, quality = [], {}
    for i in range(900):
        parts = [rng.choice(names[: rng.choice([4, 7, 32])]) if rng.random() < 0.7 else str(rng.randint(0, 60)) for _ in range(rng.randint(0, 5))]
        if i % 40 == 0:
            parts += ["deep"] * rng.randint(9, 13)
        pages.append((i, f"http://h{rng.randint(0, 2)}.org" + "".join("/" + x for x in parts) + rng.choice(["", "?q", "#f"])))
        if rng.random() < 0.6:
            quality[i] = int(not (rng.random() < 0.9 and ("spam" in parts or "nbc" in parts)))
    pages += pages[:50]
    got = verdicts(spark, pages, list(quality.items()), rules=())
    want = tree_of(pages, quality)
    assert len(got) == len(pages)
    assert {(r[1], r[2]): (r[5], r[4]) for r in got} == want and {v for _, v in want.values()} == {"allow", "block"}


@pytest.mark.parametrize("sections", [8, 12, 30])
def test_one_bad_section_among_equal_ones(spark, sections):
    names = ["spamzone"] + [f"part{chr(97 + i // 6)}{chr(97 + i % 6)}" for i in range(sections - 1)]
    rows = [(i, f"http://h.org/{names[i % sections]}/{i}") for i in range(sections * 30)]
    labels = [(i, int(i % sections != 0)) for i in range(0, sections * 30, 1) if i // sections % 2]
    got = verdicts(spark, rows * 2, labels)
    assert all((r[4] == "block") == r[2].startswith("/spamzone/") for r in got)


def test_bad_leaves_of_merged_subtrees(spark):
    """Subtrees of equal purity are merged, and their like leaves are judged together."""
    rows = [("h", f"/{a}/{b}/{i}", 1, int(b != "promo")) for a in ("en", "fr", "de") for b in ("promo", "text", "wiki") for i in range(4)]
    df = spark.createDataFrame(rows, "host string, path string, n bigint, good bigint").selectExpr("*", "slice(split(path, '/'), 2, 9) AS segments")
    tree = U.templates(df).collect()
    assert {r.parent for r in tree if "promo" in r.path} == {"/~/promo"} and {r.parent for r in tree if "text" in r.path} <= {"/~/text", "/~/~"}
