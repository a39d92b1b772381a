"""Filter audit, phrases and host reputation against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from itertools import permutations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortkit.llm import filter_audit, phrases, reputation
from cohortkit.llm.queries import SUFFIXES, URL_RULES

# ---------------------------------------------------------------- 11 filter audit


def fails(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return "".join(
        letter
        for letter, bad in zip(
            "ABCD",
            (
                len(words) < 200, 100 * len(set(words)) < 50 * len(words),
                100 * len(re.findall("[A-Z]", text)) > 3 * len(text), re.search("[#$%&*|]", text),
            ),
            strict=True,
        )
        if bad
    )


def brute_audit(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    judged = []
    for doc_id, text, lang in docs:
        again = any(o is not None and doc_id is not None and o < doc_id and (t or "") == (text or "") for o, t, _ in docs)
        judged.append((lang or "", fails(text) + "E" * again, doc_id in good, doc_id in toxic))
    out, shapley = {}, Counter()
    for part in {p for p, *_ in judged}:
        own = [j for j in judged if j[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [j for j in left if letter in j[1]]
                earlier = sum(letter in j[1] for j in own) - len(gone)
                left = [j for j in left if letter not in j[1]]
                unique = sum(j[1] == letter for j in own)
                out[part, order, step] = (len(left), len(gone), earlier, unique, sum(j[2] for j in gone), sum(j[3] for j in gone))
                shapley[part, letter] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got_audit(df):
    return {
        (r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
        for r in df.collect()
    }


DOCS = "doc_id long, text string, lang string, mask int, n int, part string"


def test_audit_equals_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choice(["one", "Two", "#x", "w" + str(rng.randrange(400))]) for _ in range(n)) for n in (0, 3, 199, 200, 260, 400)]
    pool += [" ".join(f"u{i}" for i in range(220)), "A" * 40, "é" * 97 + "AAA", "é" * 96 + "AAAA", None, ""]
    docs = [(rng.choice([None, *range(60)]), rng.choice(pool), rng.choice([None, "", "en", "de"])) for _ in range(150)]
    docs += docs[:5]
    labels = [(rng.randrange(70), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(50)] + [(None, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, 2, "x") for d in docs], DOCS)  # columns named like the operator's
    got = got_audit(filter_audit.document_audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == brute_audit(docs, labels)


def test_audit_of_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = [(r.doc_id, r.text, r.lang) for r in odd.collect()]
    assert got_audit(filter_audit.document_audit(odd, labels)) == brute_audit(docs, [])
    assert filter_audit.document_audit(none, labels).count() == 0


def test_removal_runs_name_every_order_and_mask_once():
    orders = ["".join(p) for p in permutations("ABCD")]
    seen = Counter((mask, rank) for mask, _, begin, behind in filter_audit.removal_runs("ABCD") for rank in range(begin, behind))
    assert seen == Counter((mask, rank) for mask in range(1, 16) for rank in range(24))
    for mask, step, begin, behind in filter_audit.removal_runs("ABCD"):
        for order in orders[begin:behind]:
            held = [bool(mask >> "ABCD".index(letter) & 1) for letter in order]
            assert held.index(True) + 1 == step


# ---------------------------------------------------------------- 12 phrases


def pieces_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def brute_counts(docs):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = lang or "und"
        for w in pieces_of(text):
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    return f, n


def brute_phrases(docs, least, most):
    f, n = brute_counts(docs)
    candidates = {k: a for k, a in f.items() if a >= least and len(k[1]) >= 2}
    inside = set()
    for (lang, w), a in candidates.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w) and a >= f[lang, w[i:j]]:
                    inside.add((lang, w[i:j]))
    rows = {}
    for (lang, w), a in candidates.items():
        if (lang, w) not in inside:
            cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            rows.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, n[lang], -s)
        for lang, found in rows.items()
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:most], 1)
    )


def random_texts(seed, size):
    rng = random.Random(seed)
    words = ["the", "The", "a", "é", "\x00", "\x01b", "b\x08", "~", "\U0001f600", "a\x01", "ab", "\x0b", "line\n", "of,", "x!y", "Ü"]
    return [
        (rng.choice([None, "", " "]) if rng.random() < 0.1 else "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". "]) for _ in range(rng.randrange(60))),
         rng.choice(["en", "en", "en", "de", None, "und"]))
        for _ in range(size)
    ]


@pytest.mark.parametrize("seed,least,most", [(1, 3, 2000), (2, 10, 7)])
def test_phrases_equal_brute_force(spark, seed, least, most):
    docs = random_texts(seed, 200)
    docs += docs[:20] * 3  # repeated rows
    frame = spark.createDataFrame([(t, lang, 1, "x") for t, lang in docs], "text string, lang string, n int, phrase string")
    got = phrases.collocations(frame.repartition(3), least, most).collect()
    assert sorted(map(tuple, got)) == brute_phrases(docs, least, most)


def test_phrases_of_odd_rows(odd, none):
    docs = [(r.text, r.lang) for r in odd.collect()]
    assert sorted(map(tuple, phrases.collocations(odd, 2, 50).collect())) == brute_phrases(docs, 2, 50)
    assert phrases.collocations(none, 1, 10).count() == 0


def test_a_hot_word_is_split_over_ranges(spark):
    docs = [(f"hot w{i % 50} hot w{i % 7} hot", "en") for i in range(400)]
    frame = spark.createDataFrame(docs, "text string, lang string")
    starts = phrases._ranges(phrases._text_rows(frame), 8)
    assert sum(key.startswith(b"hot\t") for _, key in starts) >= 3
    assert sorted(map(tuple, phrases.collocations(frame, 5, 100).collect())) == brute_phrases(docs, 5, 100)


def test_tries_burst_and_spill_whole_subtrees(monkeypatch):
    monkeypatch.setattr(phrases, "BURST", 8)
    docs = [(t, lang or "und") for t, lang in random_texts(5, 150) if t]
    counts = phrases.TaskCounts()
    total, last = Counter(), 0
    for i in range(0, len(docs), 10):
        text, lang = zip(*docs[i : i + 10], strict=True)
        counts.add(pa.array(lang), pa.array(text))
        assert counts.held == sum(t.size for t in counts.tries.values())
        if counts.held > 400 or i + 10 >= len(docs):
            down_to = 0 if i + 10 >= len(docs) else 200
            for lang_, own, times in counts.spill(down_to):
                keys = own.to_pylist()
                assert keys == sorted(keys)
                for key, c in zip(keys, times.tolist(), strict=True):
                    total[lang_, tuple(phrases._plain(key).split(" "))] += c
            assert counts.held <= down_to
            last += 1
    want = Counter()
    for text, lang in docs:
        for w in pieces_of(text):
            want.update((lang, tuple(w[i : i + 5])) for i in range(len(w)))
    assert last > 2 and total == want


@pytest.mark.parametrize("ranges", [0, 1, 6])
def test_blocks_of_runs_merge_whatever_their_sizes(monkeypatch, ranges):
    monkeypatch.setattr(phrases, "ROWS", 7)
    monkeypatch.setattr(phrases, "MERGED", 20)
    docs = [(t, lang or "und") for t, lang in random_texts(9, 120) if t]
    runs = []
    for i in range(0, len(docs), 30):
        counts = phrases.TaskCounts()
        text, lang = zip(*docs[i : i + 30], strict=True)
        counts.add(pa.array(lang), pa.array(text))
        runs += counts.spill(0)
    every = sorted({(lang.encode(), k) for lang, own, _ in runs for k in own.to_pylist()})
    begin = sorted(random.Random(1).sample(every, ranges))
    rows = [r for run in runs for b in phrases.blocks(*run, begin) for r in b.to_pylist()]
    got = Counter()
    for to in {r["to"] for r in rows}:
        merger = phrases.Merger(least=4)
        for r in sorted((r for r in rows if r["to"] == to), key=lambda r: (r["lang"].encode(), r["first"])):
            for lang, key, _, c in merger.add(r["lang"], r["first"], r["keys"], r["counts"]):
                got[lang, key] += c
        for lang, key, _, c in merger.close():
            got[lang, key] += c
    f, n = brute_counts(docs)
    want = {(lang, " ".join(w)): c for (lang, w), c in f.items() if c >= 4} | {(lang, None): c for lang, c in n.items()}
    got = {(lang, key if key is None else phrases._plain(key)): c for (lang, key), c in got.items() if key is None or c >= 4}
    assert got == want


# ---------------------------------------------------------------- 13 host reputation

URLS = [
    "http://a.example.com/de/1", "HTTP://A.Example.COM/en/?q", "https://x.example.net/en/", "https://example.net/en",
    "https://net/", "https://net", "https://www.foo.org/fr/a?b#c", "https://org/fr/x", "https://borg/fr/x", "no url",
    "", None, "http://u:p@h.co:80/de/?x://y/z", "//x/y", "a://b://c/d", "http://1.2.3.4/x", "http://É.Example.org/fr/é", "ftp://?x",
]
PAGES = "page_id long, url string, host string, bad int, rows int, extra int"


def parsed(url):
    if not url or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def ruled(host, path):
    fits = [
        (len(p), p, v) for p, v in URL_RULES
        if (host == p.split("/", 1)[0] or host.endswith("." + p.split("/", 1)[0])) and path.startswith("/" + p.split("/", 1)[1])
    ]
    return max(fits)[1:] if fits else None


def pages_of(spark, urls):
    return spark.createDataFrame([(i, u, "h", 7, 7, 0) for i, u in enumerate(urls)], PAGES)


def outcomes_of(spark, marks):
    return spark.createDataFrame(marks, "page_id long, bad boolean")


def test_hosts_paths_and_rules(spark):
    got = reputation.judge(pages_of(spark, URLS), outcomes_of(spark, []), URL_RULES, SUFFIXES).collect()
    assert len(got) == len(URLS)
    for r in got:
        assert (r.host, r.path) == parsed(URLS[r.page_id])
        assert (r.rule, r.verdict) == (ruled(r.host, r.path) or (None, "allow"))


def test_bad_hosts_are_blocked_and_few_outcomes_lean_on_the_domain(spark):
    rng = random.Random(1)
    urls, marks = [], []

    def host(name, n, k, times=1):
        for _ in range(times):
            for i in range(n):
                marks.append((len(urls), i < k))
                urls.append(f"http://{name}/{rng.random()}")

    for i in range(30):
        host(f"good{i}.example.com", 40, rng.randrange(4))
    host("spam.example.com", 40, 38)
    host("m.spam.example.com", 3, 3)  # few of its own, a bad domain
    host("new.example.com", 1, 1)  # one of its own, a domain of its own
    urls.append("http://www.spam.example.com/x")  # none of its own, a bad domain
    hot = len(urls)
    urls += [f"http://hot.example.com/{i}" for i in range(3000)]  # over half of all pages
    got = reputation.judge(pages_of(spark, urls), outcomes_of(spark, marks), (), SUFFIXES).toPandas()
    verdicts = got.groupby("host").verdict.agg(set)
    assert len(got) == len(urls) and got.page_id.is_unique
    assert (got.host == "hot.example.com").sum() == len(urls) - hot
    assert verdicts["spam.example.com"] == verdicts["m.spam.example.com"] == {"block"}
    for name in verdicts.index.difference(["spam.example.com", "m.spam.example.com", "www.spam.example.com"]):
        assert verdicts[name] == {"allow"}, name
    bounds = got.groupby("host").bound.max()
    assert bounds["spam.example.com"] > bounds["www.spam.example.com"] > bounds["hot.example.com"]
    assert bounds["new.example.com"] < bounds["m.spam.example.com"]


def test_suffixes_and_registered_domains(spark):
    names = {
        "a.b.example.com": ("example.com", "b.example.com"), "example.com": ("example.com", "example.com"),
        "a.b.co": ("co", "b.co"), "co": ("co", "co"), "": ("", ""), "1.2.3.4": ("", "1.2.3.4"),
        "u@x.y.de:8080": ("de", "y.de"), "[::1]": ("", "[::1]"),
    }
    hosts = spark.createDataFrame([(n,) for n in names], "host string")
    host = F.col("host")
    got = hosts.select("host", reputation.suffix_of(host, SUFFIXES).alias("s"), reputation.registered_of(host, SUFFIXES).alias("r"))
    assert {r.host: (r.s, r.r) for r in got.collect()} == names


def test_posterior_bound_is_the_beta_quantile(spark):
    rng = random.Random(4)
    pairs = [(0.5, 0.5), (1.0, 3.0), (4.2, 1.7), (40.0, 60.0), (300.0, 20.0)]
    frame = spark.createDataFrame(pairs, "a double, b double")
    for r in frame.select("a", "b", reputation.least_share(F.col("a"), F.col("b")).alias("least")).collect():
        draws = [rng.betavariate(r.a, r.b) for _ in range(40_000)]
        logits = [math.log(x / (1 - x)) for x in draws if 0 < x < 1]
        mean = sum(logits) / len(logits)
        sd = math.sqrt(sum((x - mean) ** 2 for x in logits) / len(logits))
        want = mean - 1.6448536 * sd
        assert math.log(r.least / (1 - r.least)) == pytest.approx(want, abs=0.05 * max(1, sd))


def test_reputation_of_empty_tables_and_repeated_rows(spark):
    pages = pages_of(spark, ["http://a.example.com/x"] * 2)
    assert reputation.judge(pages.limit(0), outcomes_of(spark, []), URL_RULES).count() == 0
    twice = pages.union(pages)
    marks = [(0, True), (0, False), (None, True), (1, None), (9, True)]
    got = reputation.judge(twice, outcomes_of(spark, marks), URL_RULES, SUFFIXES).collect()
    assert len(got) == 4 and {(r.labelled, r.bad) for r in got} == {(2, 2)}
