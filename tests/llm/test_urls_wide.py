"""Production globs against a plain matcher, very long URLs and very many globs."""

import random
import re
import string
import time

from sparsewell.llm import urls


def plain(glob):
    return re.compile("".join("[\\s\\S]*" if p == "**" else "[^/]*" if p == "*" else re.escape(p) for p in re.findall(r"\*\*|\*|[^*]+", glob)))


def test_production_globs_equal_plain_matcher(spark):
    rnd = random.Random(12)
    hosts = ["ads.example.com", "ADS-eu.example.net", "shop.casinos.net", "my-ads.net", "x.poker.org:8080", "user:pw@track.io.", "example.org.", "clean.site", "sex-ed.org", "cheap", "free.fr", "stats.gov", "free.example.fr", "click-me.a.b.org"]
    paths = ["", "/", "/a/login", "/login/x", "/loginx", "/ads/", "/a.jpg", "/a.jpgx", "/dir.png/x", "/cgi-bin/run", "/de/1", "/es/", "/%6Cogin", "/lo%67in/", "/%256Cogin", "/a%2Fcart", "/%63a%72t", "/x%2ejpg", "/%", "/%zz", "/%C3%A9"]
    made = [(k, f"http{rnd.choice(['', 's'])}://{rnd.choice(hosts)}{rnd.choice(paths)}{rnd.choice(['', '?q=/ads/', '#x'])}") for k in range(900)]
    patterns = [plain(g) for g in urls.BLOCK_GLOBS]
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(made, "page_id long, url string")).collect()}
    blocked = 0
    for k, url in made:
        host, path = re.match(r"[a-z]+://([^/?#]*)([^?#]*)", url).groups()
        host = host.lower()
        fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        bare = re.sub(r":[0-9]*$", "", host.rpartition("@")[2]).removesuffix(".")
        plainly = re.sub("%([0-9A-Fa-f]{2})", lambda m: c if (c := chr(int(m[1], 16))) in string.ascii_letters + string.digits + "-._~" else m[0], path)
        spam = any(p.fullmatch(f".{bare}{plainly}") for p in patterns)
        best = max(fits, key=lambda r: len(r.name), default=None)
        want = best.verdict if best else "block" if spam else "allow"
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == (host, path, best.name if best else None, want), url
        blocked += spam and not best
    assert blocked > 50


def test_very_long_urls_and_many_globs():
    long = ".a.net/" + "x" * 10_000_000
    machine = urls.ShiftAnd(["*.a.net/**", "*.b.net/**", "**xx", "**xy"])
    began = time.process_time()
    assert machine.run([b".b.net/", long.encode(), b"", (long + "y").encode(), b".a.net"]).tolist() == [[False, True, False, False], [True, False, True, False], [False] * 4, [True, False, False, True], [False] * 4]
    assert time.process_time() - began < 60
    globs = [f"*.host{k}.net/**" for k in range(10_000)]
    hits = urls.ShiftAnd(globs).run([b".x.host77.net/p", b".host9999.net/", b".nohost.net/"])
    assert [h.nonzero()[0].tolist() for h in hits] == [[77], [9999], []]


def test_encoded_twins_and_registered_domains(spark):
    rows = {"http://a.org/login": 0, "http://b.de/login": 1, "http://b.de/%6Cogin": 1, "http://b.de/%6c%6F%67in/x": 1, "http://b.de/%256Cogin": 0, "http://free.fr/a": 0, "http://stats.gov": 0, "http://metrics.edu/paper": 0, "http://ads.shop.de/": 1, "http://ads-2.shop.de": 1, "http://free-software.org/": 0}
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge_urls(df, rules=()).collect()}
    want = dict(enumerate(rows.values()))
    want[0] = 1  # without explicit rules
    assert {k: int(v == "block") for k, v in got.items()} == want


def test_filter_lists(spark):
    globs = urls.globs_of_list(["! comment", "", "# other", "||Bad.example^", "||x.net/ads", "**/tracker.js", " ||y.org/ "])
    assert globs == ("*.bad.example", "*.bad.example/**", "*.x.net/ads**", "**/tracker.js", "*.y.org/**")
    rows = {"http://bad.example": 1, "https://www.BAD.example/x": 1, "http://notbad.example/": 0, "http://x.net/adsense": 1, "http://x.net/": 0, "http://z/a/tracker.js?x": 1, "http://y.org": 0, "http://y.org/": 1}
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    assert {r.page_id: int(r.verdict == "block") for r in urls.judge_urls(df, (), globs).collect()} == dict(enumerate(rows.values()))
