from ctxrec.llm.url_filter import (DEFAULT_RULES, HOST_RULES, build_index, host_rule, judge_urls, pattern_rule, rule_tokens,
                                   token_counts)

HOSTS = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
         ("block", "com", "/de/")]
URLS = [(1, None), (2, ""), (3, "no scheme"), (4, "http://Example.ORG/es/x?q"), (5, "https://a.b.example.org/en/12#f"),
        (6, "https://notexample.org/en/1"), (7, "http://x.com/fr/1"), (8, "http://x.com/FR/1"), (9, "http://x.com/de/"),
        (10, "http://org"), (11, "http://org?x=/"), (12, "http://x.example.net/a://b.org/"), (13, "http://blog.casino-win.example.net/1"),
        (14, "http://casinos.net/"), (15, "http://x.net/" + "a/" * 5000), (4, "http://Example.ORG/es/x?q"), (None, "http://x.com/de/"),
        (16, "http://example.org/es"), (17, "http://h.com:80/fr/"), (18, "x://"), (19, "http://spam-filter.net/spam")]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:cut], rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, a) for a, h, p in HOSTS if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[1], best and best[2]


def test_contract_against_brute_force(spark):
    df = spark.createDataFrame([(i, u, "r", "v") for i, u in URLS], "page_id long, url string, rule string, verdict string")
    got = judge_urls(df).collect()
    assert len(got) == len(URLS)
    want = {}
    for i, u in URLS:
        want.setdefault(i, []).append(brute(u))
    for r in got:
        host, path, rule, verdict = want[r.page_id][0]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.page_id == 13 else "allow"))


def test_empty_table_and_no_rules(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert judge_urls(empty).count() == 0
    one = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert judge_urls(one, []).collect()[0].verdict == "allow"


def test_rules_are_filed_under_their_rarest_token(spark):
    urls = spark.createDataFrame([(i, f"http://h{i}.example.org/es/") for i in range(5)] + [(9, "http://rare.org/")],
                                 "page_id long, url string")
    rules = HOST_RULES + [host_rule("block", "rare.org/"), pattern_rule("block", "*x*")]
    counts = token_counts(urls, rules)
    assert counts["example"] == 5 and counts["org"] == 6 and counts["rare"] == 1
    index = build_index(rules, counts)
    assert [r.text for r in index["rare"]] == ["rare.org/"]
    assert [r.text for r in index[""]] == ["*x*"]
    assert rule_tokens(host_rule("block", "example.org/en/1")) == ["example", "org", "en"]


def test_many_rules(spark):
    rules = [host_rule("block", f"host{i}.net/p{i}/") for i in range(500)] + DEFAULT_RULES
    urls = spark.createDataFrame([(i, f"http://www.host{i}.net/p{i}/x") for i in range(0, 500, 50)], "page_id long, url string")
    assert {r.rule for r in judge_urls(urls, rules).collect()} == {f"host{i}.net/p{i}/" for i in range(0, 500, 50)}


def test_a_long_list_in_a_table_gives_the_same(spark):
    """Beyond ``plan_rules`` the index is a table; also with rules without a token and very many rules."""
    df = spark.createDataFrame([(i, u, "r", "v") for i, u in URLS], "page_id long, url string, rule string, verdict string")
    rules = DEFAULT_RULES + [pattern_rule("block", "*ino-w*"), pattern_rule("allow", "^1^"), host_rule("block", "org/")]
    plain = sorted(map(str, judge_urls(df, rules).collect()))
    joined = judge_urls(df, rules, plan_rules=3)
    assert joined.columns == judge_urls(df, rules).columns
    assert sorted(map(str, joined.collect())) == plain
    assert judge_urls(df.where("false"), rules, plan_rules=3).count() == 0
    many = rules + [host_rule("block", f"host{i}.net/") for i in range(25_000)]
    assert sorted(map(str, judge_urls(df, many).collect())) == plain
