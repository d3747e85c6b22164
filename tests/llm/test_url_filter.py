import math
import re
from collections import Counter

from pixelloom.llm import url_filter as U

URLS = [
    None, "", "no scheme", "http://Example.COM/en/1", "http://www.example.com/en/2", "https://a.www.example.com/en/", "http://x.net/es/5", "http://x.net/fr/5?a", "http://net/de/",
    "http://x.com", "http://x.com?q", "http://x.org/en/#f", "http://notexample.com/en/", "http://x.com:80/", "a://b://c/d", "http://É.org/É", "http://x.org/" + "a/" * 4000, "http://x.org/en/#f",
]


def plain_rule(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


def plain_scores(urls):
    """Both models by dictionaries, position for position."""

    def codes(url):
        u = re.sub(r"(?s)^.*?://", "", "".join(c.lower() if c.isascii() else c for c in url or ""))
        return [0, 0, *[U.ALPHABET.find("0" if c.isdigit() and c.isascii() else c) + 1 or U.SIZE - 1 for c in u], 0]

    counts = {True: Counter(), False: Counter()}
    for u in urls:
        if v := plain_rule(u)[3]:
            s = codes(u)
            counts[v == "allow"].update(zip(s, s[1:], s[2:], strict=False))

    def prob(n, a, b, c):
        n_c, n_b, n_bc, n_ab = (sum(v for k, v in n.items() if f(k)) for f in (lambda k: k[2] == c, lambda k: k[1] == b, lambda k: k[1:] == (b, c), lambda k: k[:2] == (a, b)))
        p = (n_c + 1) / (sum(n.values()) + U.SIZE)
        if n_b:
            t = len({k[2] for k in n if k[1] == b})
            p = (n_bc + t * p) / (n_b + t)
        if n_ab:
            t = len({k[2] for k in n if k[:2] == (a, b)})
            p = (n[a, b, c] + t * p) / (n_ab + t)
        return p

    out, known = [], {}
    for u in urls:
        s = codes(u)
        for k in zip(s, s[1:], s[2:], strict=False):
            if k not in known:
                known[k] = math.log(prob(counts[True], *k)) - math.log(prob(counts[False], *k))
        out.append(sum(known[k] for k in zip(s, s[1:], s[2:], strict=False)) / (len(s) - 2))
    return out


def test_against_plain_python(spark):
    rows = [(i, u, "clash") for i, u in enumerate(URLS)]
    got = {r.page_id: r for r in U.filter_urls(spark.createDataFrame(rows, "page_id long, url string, score string")).collect()}
    scores = plain_scores(URLS)
    for i, u in enumerate(URLS):
        host, path, rule, verdict = plain_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert abs(got[i].score - scores[i]) < 1e-6, (u, got[i].score, scores[i])
        assert verdict in (None, got[i].verdict)
    free = [i for i in got if got[i].rule is None]
    allowed, blocked = ([got[i].score for i in free if got[i].verdict == v] for v in ("allow", "block"))
    assert len(free) == len(allowed) + len(blocked) and (not allowed or not blocked or min(allowed) > max(blocked))


def test_ratio_tells_the_classes_apart(spark):
    good = [(f"http://news{i}.site/article/{i}", True) for i in range(50)]
    bad = [(f"http://xx{i}.win/cheap?pills={i}", False) for i in range(50)]
    labelled = spark.createDataFrame(good + bad, "url string, accepted boolean")
    scored = U.with_score(labelled, U.train(labelled)).cache()
    t = U.calibrate(scored).first()["threshold"]
    assert all((r.score >= t) == r.accepted for r in scored.collect())


def test_empty_table(spark):
    assert U.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_columns_of_the_names_within(spark):
    names = ["model", "symbols", "by_rule", "__model", "__verdict", "held", "accepted"]
    df = spark.createDataFrame([(i, u, *names) for i, u in enumerate(URLS)], "page_id long, url string, " + ", ".join(f"{n} string" for n in names))
    rows = U.filter_urls(df).collect()
    plain = {r.page_id: (r.rule, r.verdict, r.score) for r in U.filter_urls(df.select("page_id", "url")).collect()}
    assert {r.page_id: (r.rule, r.verdict, r.score) for r in rows} == plain and all(tuple(r[2 : 2 + len(names)]) == tuple(names) for r in rows)
