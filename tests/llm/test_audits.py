"""URL reputations, source divergences and filter audits against brute force, with nulls, empty tables and clashing columns."""

import collections
import itertools
import re

import numpy as np
import pytest

from silvaspark.llm import filter_audit, source_divergence, url_reputation

RULES = [url_reputation.Rule("allow", "com"), url_reputation.Rule("block", "example.com", "/en/"), url_reputation.Rule("allow", "www.example.com", "/en/"), url_reputation.Rule("block", "net", "/es/")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.fullmatch(r"([^/?#]*)([^?#]*).*", url.split("://", 1)[1], re.S).groups()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path, rules):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: (len(r.host + r.path), len(r.path), r.verdict == "block"), default=None)


def place(host):
    bare = re.sub(r":[0-9]*$|^.*@", "", host)
    p = bare.split(".")
    if re.match(r"[0-9.]+$|\[", bare):
        return bare, bare
    n = 2 if len(p) > 2 and len(p[-1]) == 2 and p[-2] in url_reputation.SECOND_LEVEL else 1
    return ".".join(p[-n:]), ".".join(p[-n - 1 :])


def reputation(outcomes, p=url_reputation.Params()):
    """host -> blocked, from host -> (good, n), by the definition of nested beta-binomial shrinkage."""
    of = {h: place(h) for h in outcomes}
    domains, suffixes = collections.Counter(), collections.Counter()
    dn, sn = collections.Counter(), collections.Counter()
    for h, (g, n) in outcomes.items():
        domains[of[h]] += g
        dn[of[h]] += n
        suffixes[of[h][0]] += g
        sn[of[h][0]] += n

    def strength(children):
        beyond = room = 0.0
        for group in children.values():
            group = [(g, n) for g, n in group if n]
            if group:
                k, x, n = len(group), sum(g for g, _ in group), sum(m for _, m in group)
                q = x / n * (1 - x / n)
                beyond += sum(g * g / m for g, m in group) - x * x / n - (k - 1) * q
                room += q * (n - sum(m * m for _, m in group) / n - (k - 1))
        share = beyond / room if room > 0 and beyond > 0 else 0.0
        return round(1 / min(max(share, 1 / (1 + p.strongest)), 1 / (1 + p.weakest)) - 1, 6)

    by = lambda key, rows: {k: [v for kk, v in rows if kk == k] for k in {kk for kk, _ in rows}}
    s1 = strength(by(0, [(0, (suffixes[s], sn[s])) for s in sn]))
    s2 = strength(by(0, [(d[0], (domains[d], dn[d])) for d in dn]))
    s3 = strength(by(0, [(of[h], outcomes[h]) for h in outcomes]))
    m0 = (sum(suffixes.values()) + 1) / (sum(sn.values()) + 2)
    out = {}
    for h, (g, n) in outcomes.items():
        d = of[h]
        m1 = (s1 * m0 + suffixes[d[0]]) / (s1 + sn[d[0]])
        m2 = (s2 * m1 + domains[d]) / (s2 + dn[d])
        a, b = s3 * m2 + g, s3 * (1 - m2) + n - g
        m = a / (a + b)
        out[h] = m + p.z * (m * (1 - m) / (a + b + 1)) ** 0.5 < p.least_good
    return out


def test_urls_against_brute_force(spark):
    rng = np.random.default_rng(1)
    hosts = ["www.example.com", "a.example.com", "EXAMPLE.com", "b.net", "x.b.net", "c.net:80", "u@d.co.uk", "e.co.uk", "10.0.0.1", "org", "z.org", "", "a.www.example.com", "notexample.com"]
    paths = ["", "/", "/en/1", "/es/2?x=/en/", "/en", "#/en/", "?a=b", "/es/", "/en/\n2"]
    urls = [f"{s}{h}{p}" for s in ("http://", "x://") for h, p in itertools.product(hosts, paths)]
    rows = [(k, urls[int(i)]) for k, i in enumerate(rng.integers(0, len(urls), 400))] + [(900, None), (901, "no scheme"), (None, "http://b.net/es/"), (902, "://b.net/es/"), (903, "http://" + "long." * 30000 + "net/es/x"), (900, None)]
    df = spark.createDataFrame([(*r, "h", True) for r in rows], "page_id long, url string, host string, `Rule` boolean")
    split = [(i, *parts(u)) for i, u in rows]
    judged = [(i, h, p, rule_of(h, p, RULES)) for i, h, p in split]
    outcomes = {h: (sum(r.verdict == "allow" for _, x, _, r in judged if x == h and r), sum(x == h and r is not None for _, x, _, r in judged)) for _, h, _ in split}
    bad = reputation(outcomes)
    want = collections.Counter((i, h, p, r and r.host + r.path, r.verdict if r else "block" if bad[h] else "allow") for i, h, p, r in judged)
    got = collections.Counter(tuple(r) for r in url_reputation.judge(df, RULES).collect())
    assert got == want and any(bad.values()) and not all(bad.values())
    assert url_reputation.judge(df.limit(0), RULES).count() == 0
    assert {r.verdict for r in url_reputation.judge(df, []).collect()} == {"allow"}


def test_hosts_go_by_their_outcomes(spark):
    """Given outcomes: a bad host is blocked, its good neighbour is not, and one without outcomes follows its domain."""
    rows = [(f"http://{h}/{k}", v) for h, v, n in (("bad.a.org", False, 60), ("good.b.org", True, 60), ("new.a.org", None, 1), ("new.b.org", None, 1), ("m.a.org", False, 50)) for k in range(n)]
    rows += [(f"http://h{k % 20}.c{k % 7}.com/", k % 10 != 0) for k in range(400)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, ok boolean")
    from pyspark.sql import functions as F

    got = {r.host: r.verdict for r in url_reputation.judge(df, [], good=F.col("ok")).collect()}
    assert got["bad.a.org"] == got["new.a.org"] == "block" and got["good.b.org"] == got["new.b.org"] == "allow" and got["h1.c1.com"] == "allow"
    with pytest.raises(ValueError, match="allows or blocks"):
        url_reputation.Rule("maybe", "com")


def terms(text):
    return [t.translate({k: k + 32 for k in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def divergences(rows, least=3, ranks=200):
    rows = [(t, lg or "", s or "") for t, lg, s in rows]
    df, counts = collections.Counter(), collections.Counter()
    for t, lg, s in rows:
        w = terms(t)
        df.update({(lg, x) for x in w})
        counts.update((lg, s, x) for x in w)
    out = set()
    for lg in {r[1] for r in rows}:
        kept = [x for (a, x), n in df.items() if a == lg and n >= least]
        sources = {r[2] for r in rows if r[1] == lg}
        total = {s: sum(counts[lg, s, x] for x in kept) for s in sources}
        share = lambda n, m: 1 + 10**9 * (n + 1) // (m + len(kept))  # noqa: E731, B023
        p = {s: {x: share(counts[lg, s, x], total[s]) for x in kept} for s in sources}
        q = {x: share(sum(counts[lg, s, x] for s in sources), sum(total.values())) for x in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(f(p[s][x], p[o][x]) for x in kept)) for o in sources if o != s]
            top = [(x, f(p[s][x], q[x])) for x in kept if counts[lg, s, x] > 0 and p[s][x] > q[x]]
            for part, items, most in (("pair", pairs, None), ("term", top, ranks)):
                items.sort(key=lambda z: (-z[1], z[0].encode()))
                out |= {(lg, s, part, x, v, k) for k, (x, v) in enumerate(items[:most], 1)}
    return out


def test_divergences_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(source_divergence, "PAIRS", 50)
    rng = np.random.default_rng(2)
    words = ["a", "B", "é", "Éa", "中文", "x1y", "the", "The", "of", "ß", "zz", "\u2028", "😀"]
    text = lambda: " ".join(words[int(i)] for i in rng.integers(0, len(words), int(rng.integers(0, 12))))
    rows = [(text(), ["en", "de", None][int(a)], ["s1", "s2", "S3", None, "é"][int(b)]) for a, b in zip(rng.integers(0, 3, 90), rng.integers(0, 5, 90), strict=True)]
    rows += [(None, "fr", "s1"), ("a b", "fr", "s2"), ("", "xx", "s1"), ("the of", "en", "s1"), ("the of", "en", "s1")] + [("only once", "en", "lone")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, source string, value long")
    got = {tuple(r) for r in source_divergence.divergences(df, ranks=5).collect()}
    assert got == divergences(rows, ranks=5)
    assert source_divergence.divergences(df.limit(0)).count() == 0


@pytest.mark.parametrize("pairs", [1, 7, 1000])
def test_shared_terms_in_blocks(monkeypatch, pairs):
    """Sums over the pairs of entries in each row, in blocks of any size."""
    monkeypatch.setattr(source_divergence, "PAIRS", pairs)
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 6, 20)
    indptr = np.concatenate([[0], np.cumsum(sizes)])
    source = np.concatenate([rng.permutation(6)[:n] for n in sizes]).astype(np.int64)
    p = rng.integers(1, 10**9, len(source))
    p0 = rng.integers(1, 10**6, 6)[source]
    f = lambda a, b: (int(a) - int(b)) ** 2 // int(b)
    want = collections.Counter()
    for a, b in zip(indptr, indptr[1:], strict=False):
        for i, j in itertools.permutations(range(a, b), 2):
            want[int(source[i]) * 6 + int(source[j])] += f(p[i], p[j]) - f(p[i], p0[j]) - f(p0[i], p[j]) + f(p0[i], p0[j])
    keys, sums = source_divergence.both(indptr, source, p, p0, 6)
    assert dict(zip(keys.tolist(), sums.tolist(), strict=True)) == dict(want)


@pytest.mark.parametrize("size", [3, 17, 1 << 20])
def test_terms_at_any_cut(monkeypatch, size):
    monkeypatch.setattr(source_divergence, "BYTES", size)
    rng = np.random.default_rng(3)
    for _ in range(100):
        texts = ["".join("aBé \n1中Z"[int(i)] for i in rng.integers(0, 8, int(rng.choice([0, 0, 1, 5, 60])))) for _ in range(int(rng.integers(1, 6)))]
        raw = [t.encode() for t in texts]
        held: dict[bytes, int] = {}
        got = source_divergence.document_terms(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), held)
        names = [t.decode() for t in held]
        assert {(int(d), names[t]): int(n) for d, t, n in zip(*got, strict=True)} == dict(collections.Counter((k, w) for k, t in enumerate(texts) for w in terms(t)))


def test_equal_hashes_of_different_terms(monkeypatch):
    """Slices that a hash takes for equal are told apart by their bytes."""
    monkeypatch.setattr(source_divergence.xxhash, "xxh3_64_intdigest", lambda b: len(b))
    held: dict[bytes, int] = {}
    raw = b"ab cd ab ef x cd ab"
    _, t, n = source_divergence.document_terms(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), held)
    names = list(held)
    assert {names[k]: int(c) for k, c in zip(t, n, strict=True)} == {b"ab": 3, b"cd": 2, b"ef": 1, b"x": 1}


def audit(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}

    def failed(i, t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > first[t])
        return {f for f, x in zip("ABCDE", tests, strict=True) if x}

    rows = [(lg or "", failed(i, t), i in good, i in toxic) for i, t, lg in docs]
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        total = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total[f] += len(gone)
                out[part, order, step] = (len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone))
        for order, step in {k[1:] for k in out if k[0] == part}:
            out[part, order, step] += (total[order[step - 1]],)
    return out


def test_filter_audit_against_brute_force(spark):
    rng = np.random.default_rng(4)
    long = " ".join(f"w{k}" for k in range(120))
    kinds = [None, "", " \t\n", long, long + " $", "A B " * 60, long.upper(), "x " * 150, "\u00a0" * 5, "ÀÉ b", long + "\x0b\x1c"]
    docs = [(int(i), kinds[int(k)], ["en", "de", None, ""][int(p)]) for i, k, p in zip(rng.permutation(300), rng.integers(0, len(kinds), 300), rng.integers(0, 4, 300), strict=True)]
    docs += [(5000, long, "en"), (5000, long, "en"), (None, long, "en"), (None, long, "de"), (-1, long, "de"), (-1, long, "en"), (7000, "Z" * 3_000_000, "en")]
    labels = [(i, int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in range(0, 300, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1), (9999, 1, 1), (5000, None, 1)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, lang string, mask int, sha int")
    lb = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.audit_documents(df, lb).collect()}
    assert got == audit(docs, labels)
    assert filter_audit.audit_documents(df.limit(0), lb).count() == 0
    assert filter_audit.audit_documents(df, lb.limit(0)).count() == len(got)
