"""Small tables with nulls, ties, repeats and clashing names, next to brute force in plain Python."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keysift.llm import decontam, dedup, langid, licenses, mixing, pii, quality, rules, tokens, urls
from keysift.session import scratch_path

DOCS = "doc_id long, text string, source string"
VOCABULARY = [a + b for a in ("ba", "ko", "tri", "lem", "nus", "par") for b in ("do", "ve", "nit", "sa")]


def frame(spark, rows, schema=DOCS, partitions=3):
    return spark.createDataFrame(rows, schema).repartition(partitions)


def prose(seed: int, n: int) -> str:
    chosen = random.Random(seed)
    return " ".join(chosen.choice(VOCABULARY) + str(chosen.randint(0, 40)) for _ in range(n))


# Personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number: str) -> bool:
    total = 0
    for i, digit in enumerate(map(int, reversed(number))):
        total += digit if i % 2 == 0 else sum(divmod(digit * 2, 10))
    return total % 10 == 0


def base_spans(text: str) -> list[str]:
    found = []
    for kind, pattern in BASE.items():
        for match in re.finditer(pattern, text):
            value = match[0]
            number = re.sub("[^0-9]", "", value)
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in value.split(".")),
                "card": 13 <= len(number) <= 19 and luhn(number),
                "phone": 9 <= len(number) <= 15,
            }[kind]
            if good:
                found.append(f"{kind}:{match.start()}:{match.end()}")
    return found


PII_TEXTS = [
    None,
    "",
    "a@b.c@d.e and a@b.c+d@e.f, x@@y.z, é@b.de, a.b-c_d%+@x-y.co.uk.",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3 10.0.0.1, 1.2.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111 378282246310005 0000000000000",
    "+1 (555) 555-1234 +1 2 +49 30 1234567890123456 ++44 20 7946 0958. +4 4",
    "𝒳𝒴 a@b.cd 𝒵 +1 (168) 555-5254 ü 4111111111111111",
    "9" * 30_000 + " 4111111111111111 " + "a" * 50_000 + "@x.yz " + "1 " * 20_000,
    "." * 20_000 + "@" * 5_000 + "+1" + "-" * 20_000,
]


def test_pii_base(spark):
    rows = [(i, text) for i, text in enumerate(PII_TEXTS)] + [(None, PII_TEXTS[2]), (2, PII_TEXTS[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find(df).select("doc_id", "text", pii.listed(pii.F.col("base")).alias("base")).collect()
    assert len(found) == len(rows)
    for row in found:
        assert row.base == ",".join(base_spans(row.text)), row.text[:80]


@pytest.mark.parametrize("seed", range(5))
def test_pii_base_random(spark, seed):
    chosen = random.Random(seed)
    texts = ["".join(chosen.choices("a1.@+- 2(é)", k=60)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in pii.with_base_spans(df, "text", "spans").collect():
        assert [f"{s.type}:{s.start}:{s.end}" for s in row.spans] == base_spans(row.text), row.text


def test_pii_disclosive_terms(spark):
    rows = []
    for i in range(6):  # six surroundings of one address, all with the same name
        rows.append((i, f"{prose(i, 30)} Zarathon, writes zar@mail.org {prose(i + 50, 30)}"))
    for i in range(6, 106):
        rows.append((i, prose(i, 60)))
    for i in range(106, 126):  # mirrors are one surrounding
        rows.append((i, f"{prose(106, 30)} Mirrored page by mir@mail.org {prose(107, 30)}"))
    rows += [(200, "Here is (ZARATHON) again."), (201, None), (None, "zarathon"), (200, "Here is (ZARATHON) again.")]
    found = {}
    for row in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(row.doc_id, []).append(row)
    for i in range(6):
        (row,) = found[i]
        assert [s.match for s in row.terms if s.match == "Zarathon"] == ["Zarathon"]
        assert "zar@mail.org" not in row.sanitised and "Zarathon" not in row.sanitised
    assert [(s.start, s.end) for s in found[200][0].terms] == [(9, 17)] and len(found[200]) == 2
    assert found[200][0].sanitised == "Here is ([TERM]) again."
    assert found[None][0].terms[0].match == "zarathon"
    for i in range(6, 126):
        assert found[i][0].terms == []
    assert found[110][0].sanitised.count("[EMAIL]") == 1


def test_pii_disclosure_is_brute_force(spark):
    rows = [(i, f"{prose(i % 7, 6)} kavo kavo x{i % 3}@m.org lum {prose(i, 5)}") for i in range(40)]
    df = spark.createDataFrame(rows, "pii_id long, pii_text string")
    spanned = pii.with_base_spans(df, "pii_text", "pii_spans")
    params = pii.Disclosure(reach=20, support=2, generalise=0.1)
    found = {r.term: r.disclosure for r in pii.disclosive_terms(spanned, df, params).collect()}

    def terms(text):
        return [w.strip(pii.PUNCTUATION).lower() for w in re.split(pii.SPACE, text)]

    n_term = Counter(t for _, text in rows for t in terms(text) if t)
    n_all, both, places, n_entity = sum(n_term.values()), Counter(), defaultdict(set), Counter()
    for _, text in rows:
        for match in re.finditer(BASE["email"], text):
            n_entity[match[0]] += 1
            left = text[max(0, match.start() - 20) : match.start()]
            left = re.sub(f"^{pii.WORD}", "", left) if match.start() > 20 else left
            right = text[match.end() : match.end() + 21]
            right = re.sub(f"{pii.WORD}$", "", right) if len(right) > 20 else right
            for t in terms(left + " " + right):
                if t and not re.search(r"x\d@m\.org", t):
                    both[match[0], t] += 1
                    places[match[0], t].add(left + " " + right)
    expected = {}
    for (c, t), n in both.items():
        if len(places[c, t]) >= 2:
            given = min(1.0, n / n_term[t])
            d = 1 - math.log(given) / math.log(n_entity[c] / (n_all + n_entity[c]))
            if d >= 0.1:
                expected[t] = max(d, expected.get(t, 0))
    assert found == pytest.approx(expected) and "kavo" in found


def test_pii_terms_of_any_length_and_with_digits(spark):
    rows = []
    for i in range(6):
        rows.append((i, f"{prose(i, 30)} jdoe42 王伟 K7-99X zar@mail.org +1 (168) 555-5254 {prose(i + 50, 30)}"))
    rows += [(i, prose(i, 60)) for i in range(6, 106)]
    rows.append((200, "Ask (JDOE42), 王伟 or k7-99x, not zar@mail.org."))
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(6):
        assert [s.match for s in found[i].terms] == ["jdoe42", "王伟", "K7-99X"]
        assert not re.search("jdoe42|王伟|K7-99X|zar@|555", found[i].sanitised)
    assert [s.match for s in found[200].terms] == ["JDOE42", "王伟", "k7-99x"]
    assert all(found[i].terms == [] for i in range(6, 106))


def test_pii_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find(empty).collect() == []


# Quality

GOOD = "The house of {0} is old, and it stands by the river. Nobody knows why."
BAD = "{0}$$$ ### {0}%%% | {0}&&& | ***"


def quality_rows(n=400):
    return [(i, (BAD if i % 5 == 0 else GOOD).format(f"word{i}") * (1 + i % 3), "s") for i in range(n)]


def test_quality_learns_from_positives_only(spark):
    docs = frame(spark, quality_rows())
    labels = spark.createDataFrame(
        [(i, 1) for i in range(0, 400, 2) if i % 5] + [(7, 0), (7, 1), (None, 1), (9999, 1)],
        "doc_id long, quality int",
    )
    model = quality.fit(docs, labels)
    assert 0.6 < model.prior < 0.95
    more = [(1000, GOOD.format("thing")), (1001, BAD.format("thing")), (1002, None), (1003, ""), (None, "x" * 500_000)]
    clashing = spark.createDataFrame(more, "doc_id long, text string").withColumn("Score", quality.F.lit("old"))
    scored = {r.doc_id: r.score for r in quality.with_quality(clashing, model).collect()}
    assert scored[1000] > 0.7 and scored[1001] < 0.3
    assert all(0 <= s <= 1 for s in scored.values()) and scored[1002] == scored[1003]
    again = quality.Model.from_json(model.to_json())
    assert {r.doc_id: r.score for r in quality.with_quality(clashing, again).collect()} == scored


def test_quality_without_positives_or_rows(spark):
    docs, none = frame(spark, quality_rows(20)), spark.createDataFrame([], "doc_id long, quality int")
    scored = quality.with_quality(docs, quality.fit(docs, none)).collect()
    assert {r.score for r in scored} == {0.5}
    model = quality.fit(docs.limit(0), none)
    assert quality.with_quality(docs.limit(0), model).collect() == []


def test_quality_moments_are_exact(spark):
    rows = quality_rows(30)
    texts = spark.createDataFrame([(t, i % 2 == 0) for i, t, _ in rows] + [(None, False)], "text string, positive boolean")
    x = np.array([quality.features(t) for t in [r[1] for r in rows] + [None]])
    own = x[[i % 2 == 0 for i in range(30)] + [False]]
    positive, every = quality.moments(texts.repartition(3))
    assert np.allclose(every, x.T @ x / 31) and np.allclose(positive, own.T @ own / 15)


def test_quality_risk_is_the_definition():
    random_ = np.random.default_rng(0)
    p, u, w = random_.normal(size=(50, 4)), random_.normal(size=(80, 4)), random_.normal(size=4)
    p[:, -1] = u[:, -1] = 1

    def loss(z):
        return ((1 - z) ** 2 / 4).mean()

    ours, rest = quality.nn_risk(w, 0.3, p.T @ p / 50, u.T @ u / 80)
    assert ours == pytest.approx(0.3 * loss(p @ w))
    assert rest == pytest.approx(loss(-(u @ w)) - 0.3 * loss(-(p @ w)))


def test_quality_posterior_is_monotone():
    own, every = np.zeros(quality.BINS), np.zeros(quality.BINS)
    own[100:110] = [1, 5, 3, 10, 20, 15, 30, 40, 40, 50]
    every[95:110] = 60
    values = quality.posterior(0.5, own, every)
    assert (np.diff(values) >= -1e-12).all() and 0 <= values.min() and values.max() <= 1


# URLs

URLS = [
    None,
    "",
    "no scheme/en/1",
    "http://example.org",
    "http://EXAMPLE.org/",
    "http://a.example.org/es/1?x=/en/",
    "http://badexample.org/es/1",
    "https://x.y.example.org/en/123#top",
    "http://example.org/e",
    "http://foo.com/fr/1",
    "http://foo.com/de",
    "http://foo.com/de/",
    "http://com/fr/",
    "http://a..com/de/x",
    "http://example.org:80/es/",
    "x://y://example.org/es/",
    "http://é.com/fr/ü#/de/",
    "http://" + "a." * 5000 + "com/de/" + "x" * 100_000,
]


def judged(url, rules_):
    after = (url or "").split("://", 1)
    host = re.match(r"[^/?#]*", after[1])[0] if len(after) == 2 else ""
    path = re.match(r"[^?#]*", after[1][len(host) :])[0] if len(after) == 2 else ""
    host = host.translate(dedup.LOWER)
    fits = [
        (len(h + p), len(h), v, h + p)
        for h, p, v in rules_
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, 0, "allow", None))
    return host, path, best[3], best[2]


@pytest.mark.parametrize("most", [urls.BROADCAST_RULES, 0])
def test_urls(spark, monkeypatch, most):
    monkeypatch.setattr(urls, "BROADCAST_RULES", most)
    rules_ = [*urls.RULES, ("y.example.org", "/en/12", "allow"), ("foo.com", "/fr/", "allow"), ("foo.com", "/fr/", "block")]
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(3, URLS[3], "again"), (None, URLS[5], "h"), (None, None, "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    table = urls.rules_table(spark, [*rules_, (None, "/", "block")])
    got = urls.judge(pages, table).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == Counter(
        (i, *judged(u, rules_)) for i, u, _ in rows
    )


def test_urls_equal_pages_stay_spread(spark):
    rows = spark.range(6000, numPartitions=6).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("page_id"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("http://a.com/de/"), "id")).alias("url"),
    )
    got = urls.judge(rows, urls.rules_table(spark))
    none = got.where("url IS NULL").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in none) == 2000 and max(r["count"] for r in none) <= 400
    assert got.groupBy("verdict").count().orderBy("verdict").collect() == [("allow", 2000), ("block", 4000)]


def test_urls_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    none = urls.rules_table(spark, [])
    assert [(r.rule, r.verdict) for r in urls.judge(pages, none).collect()] == [(None, "allow")]
    assert urls.judge(pages.limit(0), urls.rules_table(spark)).collect() == []


def test_urls_prefix_collision_is_not_a_match(spark, monkeypatch):
    monkeypatch.setattr(urls, "PREFIX_HEX", 0)  # every digest shares the prefix
    rows = list(enumerate(URLS))
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), urls.rules_table(spark)).collect()
    assert sorted((r.page_id, r.rule or "") for r in got) == sorted((i, judged(u, urls.RULES)[2] or "") for i, u in rows)


# Near duplicates


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(dedup.LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute_components(rows, k):
    sets = [shingle_set(text, k) for _, text in rows]
    head = list(range(len(rows)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            head[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(
        ((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str
    )


def near_rows():
    rows, chosen = [], random.Random(3)
    for group in range(12):
        words = prose(group, 60).split()
        for copy in range(12):
            edited = list(words)
            for _ in range(copy % 5):
                edited[chosen.randrange(60)] = f"new{chosen.randint(0, 9)}"
            rows.append((len(rows) * 7 % 1009, " ".join(edited)))
    passage = prose(99, 40)  # many share half of their text, none is near another
    rows += [(2000 + i, passage + " " + prose(500 + i, 40)) for i in range(40)]
    rows += [(3000 + i, t) for i, t in enumerate(["one two", "ONE  two", "one", "", " \n", None, "x " * 3000, "x " * 9])]
    rows += [(3003, ""), (rows[0][0], rows[0][1]), (None, rows[1][1]), (None, "alone here"), (None, None), (5, rows[30][1])]
    return rows


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, k):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = dedup.near_duplicates(docs.withColumn("node", dedup.F.lit(1)), dedup.MinHash(words=k)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute_components(rows, k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicates_links_that_no_hub_has(spark, monkeypatch):
    """A chain in one bucket: each text is near the next alone."""
    words = [f"w{i}" for i in range(120)]
    rows = [(100 - i, " ".join(words[i * 6 : i * 6 + 70])) for i in range(9)]
    params = dedup.MinHash(words=1, bands=64, rows=2)
    found = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), params).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute_components(rows, 1)
    assert len({r.component_id for r in found}) == 1


def near_copies(n, edits, seed, stock=8, length=100):
    """Copies of one text, each with some words replaced by others of a small stock."""
    chosen = random.Random(seed)
    words = prose(seed, length).split()[:length]
    rows = []
    for i in range(n):
        own = list(words)
        for place in chosen.sample(range(len(own)), chosen.choice(edits)):
            own[place] = f"new{chosen.randrange(stock)}"
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize("edits, k", [((2, 3, 4), 4), ((6, 9, 12, 15), 1), ((4, 5, 6), 4)])
def test_near_duplicates_among_copies_around_the_threshold(spark, monkeypatch, edits, k):
    """Most pairs share buckets and lie at 50 to 85 %: all links are found, by few comparisons."""
    compared = []
    confirmed = dedup.confirmed
    monkeypatch.setattr(
        dedup, "confirmed", lambda pairs, *rest: (compared.append(pairs.count()), confirmed(pairs, *rest))[1]
    )
    rows = near_copies(260, edits, 11)
    params = dedup.MinHash(words=k, bands=64, rows=3)
    found = dedup.near_duplicates(frame(spark, rows, "doc_id long, text string"), params).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute_components(rows, k)
    assert sum(compared) < 40 * len(rows)


def test_differences_tell_who_is_alike(spark):
    """The weights and common tokens of ``differences`` give the intersections themselves."""
    rows = near_copies(40, (2, 4, 8), 3)
    params = dedup.MinHash(words=2, bands=4, rows=1)
    sets = {i: np.unique([zlib.crc32(x.encode()) for x in map(" ".join, zip(t.split(), t.split()[1:]))]) for i, t in rows}
    table = spark.createDataFrame([(bytes([i]), x.tolist()) for i, x in sets.items()], "node binary, shingles array<long>")
    members = [(7, bytes([i]), len(x), len(x) - (i != 5)) for i, x in sets.items()]
    members = spark.createDataFrame(members, "bucket long, node binary, n_shingles long, n_shared long")
    roots = members.select("node", F.col("node").alias("root"))
    weights, tokens_ = {}, {}
    for r in dedup.differences(members, roots, table, params).collect():
        assert r.hub == bytes([5])
        weights[r.node[0]] = r.weight
        tokens_[r.node[0]] = set(r.tokens)
    for a, b in itertools.combinations(weights, 2):
        common = len(np.intersect1d(sets[a], sets[b]))
        alike = 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common)
        assert alike == (360 * len(tokens_[a] & tokens_[b]) >= weights[a] + weights[b])


def test_prefilter_keeps_every_partner(spark):
    rows = spark.range(3000).selectExpr("id", "id % 7 AS other")
    keys = spark.range(0, 3000, 10).selectExpr("id AS name")
    found = dedup.prefiltered(rows, F.col("id"), keys, F.col("name"))
    assert found.columns == rows.columns
    ids = [row.id for row in found.collect()]
    assert set(range(0, 3000, 10)) <= set(ids)
    assert len(ids) == len(set(ids)) < 400
    assert dedup.prefiltered(rows, F.col("id"), keys.limit(0), F.col("name")).isEmpty()


def test_drop_near_duplicates(spark):
    rows = [(d, t, f"s{i}") for i, (d, t) in enumerate(near_rows())]
    docs = frame(spark, rows)
    kept = dedup.drop_near_duplicates(docs, dedup.MinHash(words=5))
    assert kept.columns == docs.columns
    parts = defaultdict(list)
    for r in kept.collect():
        parts[shingle_set(r.text, 5)].append(r.doc_id)
    blank = [d for d, t, _ in rows if not (t or "").split()]
    assert sorted(parts.pop(frozenset()), key=str) == sorted(blank, key=str)
    assert all(len(ids) == 1 for ids in parts.values())
    heads = {c for d, n, c in brute_components([r[:2] for r in rows], 5) if n}
    assert {d for ids in parts.values() for d in ids} == heads
    assert dedup.drop_near_duplicates(docs.limit(0)).collect() == []


def test_components(spark):
    chosen = random.Random(5)
    edges = [(chosen.randrange(200), chosen.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    found = dedup.components(spark.createDataFrame(edges, "a long, b long"))
    head = {}

    def find(x):
        while head.setdefault(x, x) != x:
            x = head[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        head[high] = low
    expected = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert {r.node: r.root for r in found.collect()} == expected


# Languages

LANGUAGE_WORDS = {
    "en": "the house and river with old stone near them",
    "de": "das haus und der fluss mit altem stein neben ihnen über",
    "fr": "la maison et la rivière avec vieille pierre près d'eux",
}


def language_rows(n=90):
    chosen, rows = random.Random(1), []
    for i in range(n):
        lang = list(LANGUAGE_WORDS)[i % 3]
        rows.append((i, " ".join(chosen.choices(LANGUAGE_WORDS[lang].split(), k=20)), lang))
    return rows


def all_cuts(word):
    for n in range(len(word)):
        for places in itertools.combinations(range(1, len(word)), n):
            bounds = [0, *places, len(word)]
            yield [word[a:b] for a, b in zip(bounds, bounds[1:])]


def test_language_sums_all_segmentations():
    pieces = ["▁", "▁a", "ab", "a", "b", "ba", "bab", "▁ab"]
    lattice = langid.Lattice(pieces)
    p = np.random.default_rng(0).random((len(pieces) + 2, 2))
    p[-1] = 0
    number = {x: i for i, x in enumerate(pieces)}
    for word in ("ab", "abab", "babab", "aqb"):
        expected = np.zeros(2)
        for cut in all_cuts("▁" + word):
            ids = [number.get(x, lattice.unknown if len(x) == 1 else lattice.unknown + 1) for x in cut]
            expected += np.prod(p[ids], axis=0)
        assert np.allclose(np.exp(langid.word_scores([word], lattice, p)[0]), expected)
        assert np.allclose(np.exp(langid.log_probability(lattice.tables([word])[0], p)), expected)


def test_language(spark):
    docs = spark.createDataFrame(language_rows(), "doc_id long, text string, lang string")
    odd = [(None, None, "en"), (900, None, None), (901, "x", None), (None, "das", "de")]
    model = langid.fit(docs.union(spark.createDataFrame(odd, docs.schema)))
    assert model.languages == ["de", "en", "fr"]
    assert np.allclose(model.probabilities[:-1].sum(axis=0), 1)
    texts = [(1, "the old river"), (2, "über den alten Fluss"), (3, "près de la rivière"), (4, None), (5, ""), (6, "12 ½ — ²"), (7, "the " * 50_000), (8, "h" * 3000), (None, "das haus"), (1, "the old river")]
    asked = spark.createDataFrame(texts, "doc_id long, text string").withColumn("Language", langid.F.lit(0))
    found = langid.with_language(asked, model)
    got = {(r.doc_id, r.text): r.language for r in found.collect()}
    assert found.count() == len(texts)
    assert [got[t].lang for t in texts[:7]] == ["en", "de", "fr", "und", "und", "und", "en"]
    assert all(0 <= x.score <= 1 for x in got.values()) and got[(4, None)].score == 0
    none = langid.fit(docs.limit(0))
    assert {r.language.lang for r in langid.with_language(asked, none).collect()} == {"und"}


# Mixing


def water(sizes, weights, share, limit):
    total = share * sum(sizes.values())
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_ = dict.fromkeys(order, 0.0), set(order)
    left = total
    while left > 1e-9 and open_:
        unit = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += unit * weight[s]
            if target[s] >= limit * sizes[s]:
                left += target[s] - limit * sizes[s]
                target[s] = float(limit * sizes[s])
                open_.remove(s)
    return target


def mix_rows():
    chosen, rows = random.Random(2), []
    for i in range(1500):
        source = chosen.choice(["b", "a", "é", "c", "", None, "b", "b", "b"])
        rows.append((i, "w " * int(chosen.paretovariate(1.2) * 8), source))
    rows += [(None, "w w", "a"), (None, None, None), (3, None, "b"), (3, "w", "b"), (4, "w", "b"), (4, "w", "b"), (5, " \n", "empty")]
    return rows


def test_mix(spark):
    rows = mix_rows()
    docs = frame(spark, rows).withColumn("COPIES", mixing.F.lit("x"))
    found = mixing.with_copies(docs, mixing.word_count(mixing.F.col("text"))).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in found) == Counter(rows)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    expected = water(sizes, (3, 1, 2), 1.5, 2)
    taken, largest = Counter(), Counter()
    for r in found:
        assert r.size == len((r.text or "").split()) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(expected[r.source]) and 0 <= r.taken <= 2 * r.size
        assert r.taken == r.copies * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert sum(expected.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for source, target in expected.items():
        assert abs(taken[source] - target) <= 1.5 * largest[source] + 0.01 * target
    again = mixing.with_copies(frame(spark, rows[::-1], partitions=5), mixing.word_count(mixing.F.col("text")))
    key = lambda r: str((r.doc_id, r.text, r.source, r.copies))
    assert sorted(map(key, again.collect())) == sorted(map(key, found))


def test_mix_rows_without_id_are_spread_by_content(spark, monkeypatch):
    cells, write = [], mixing.stored

    def seen(df, name):
        cells.append((name, write(df, name)))
        return cells[-1][1]

    monkeypatch.setattr(mixing, "stored", seen)
    rows = [(None, f"a{i} b{i}", "s") for i in range(3000)]
    docs = frame(spark, rows).selectExpr("*", "1 AS mix_start", "2 AS mix_rank", "3 AS mix_order", "4 AS MIX_KEY")
    drawn = mixing.mix(docs)
    assert drawn.columns == docs.columns and drawn.count() == pytest.approx(4500, abs=1)
    found = dict(cells)["mix-cells"]
    assert found.count() > 200 and found.agg(mixing.F.max("n")).first()[0] < 60


def test_rules_keep_columns_of_inner_names(spark):
    docs = spark.createDataFrame([(1, "a b", "one b")], "q_id long, Q_WORDS string, q_text string")
    (row,) = rules.rate(docs, text="q_text").collect()
    assert (row["q_id"], row["Q_WORDS"], row["q_text"], row["n_words"]) == (1, "a b", "one b", 2)


def test_mix_repeats_rows(spark):
    docs = frame(spark, mix_rows()).withColumn("size", mixing.F.lit("own"))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and {r["size"] for r in mixed.collect()} == {"own"}
    counted = mixing.with_copies(docs, mixing.word_count(mixing.F.col("text")))
    assert mixed.count() == counted.agg(mixing.F.sum("copies")).first()[0]
    assert mixing.mix(docs.limit(0)).collect() == []
    blank = frame(spark, [(1, None, "a"), (2, "", None)])
    assert [r.taken for r in mixing.with_copies(blank, mixing.word_count(mixing.F.col("text"))).collect()] == [0, 0]


# Quality rules


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 5)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


RULE_TEXTS = [
    None,
    "",
    " \n\t\n ",
    "a b c d e " * 3,
    "a a a a a a a",
    "one two three four five six seven one two three four five",
    "line one\nline one\n\nline  one\nother\r\nother\n",
    "# * $ % & | < > é𝒳 ##",
    "The house of the old man is by the river and it was built with stone from the hill.",
    "\x0b\x0c x\x1fy \x85z",
    prose(1, 3000) + " " + prose(1, 50),
    "x " * 20_000,
]


def test_rules(spark):
    rows = list(enumerate(RULE_TEXTS)) + [(None, "a b"), (3, RULE_TEXTS[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("KEPT", rules.F.lit(1))
    found = rules.rate(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == measures(r.text), r.text and r.text[:60]
        assert r.kept == (r.broken == [])
    by_id = {r.doc_id: r for r in found}
    assert by_id[8].kept and not by_id[0].kept and "length" in by_id[0].broken
    assert "repeated words" in by_id[11].broken and "symbols" in by_id[7].broken
    assert rules.rate(docs.limit(0)).collect() == []


def test_rules_plan_has_no_exchange_and_no_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    plan = rules.rate(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


# Decontamination


def distance(a, b):
    """Least edit distance of a to any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


@pytest.mark.parametrize("seed", range(200))
def test_edit_distance(seed):
    chosen = random.Random(seed)
    a = chosen.choices(range(1, 6), k=chosen.randint(1, 90))
    b = chosen.choices(range(6), k=chosen.randint(0, 120))
    if seed % 2:
        b = b[:20] + a + b[20:]
        for _ in range(4):
            b[chosen.randrange(len(b))] = 0
    best, end = decontam.best_run(a, b)
    assert best == distance(a, b)
    assert best == len(a) or distance(a, b[:end]) == best and distance(a, b[: end - 1]) > best


def edited(words, n, chosen):
    words = list(words)
    for _ in range(n):
        at = chosen.randrange(len(words))
        kind = chosen.randrange(3)
        words[at : at + 1] = [[], ["edit"], [words[at], "more"]][kind]
    return words


def test_decontamination(spark):
    chosen = random.Random(4)
    items = {i: prose(i, chosen.randint(10, 70)).split() for i in range(40)}
    rows, expected = [], set()
    for i in range(400):
        words = prose(1000 + i, 150).split()
        item = chosen.choice(list(items))
        if i % 2:
            most = len(items[item]) // 10
            at = chosen.randrange(150)
            words[at:at] = edited(items[item], chosen.randint(0, most), chosen)
        rows.append((i, ", ".join(words).upper(), "x"))
    for i, text, _ in rows:
        words = decontam.words_of(text)
        for item, own in items.items():
            if i % 2 and distance(own, words) <= len(own) // 10:
                expected.add((i, item))
    bench = spark.createDataFrame(
        [(i, " ".join(w)) for i, w in items.items()] + [(500, None), (None, "a b c d e f g h"), (501, "short"), (502, "")],
        "item_id long, text string",
    )
    docs = frame(spark, [*rows, (900, None, "x"), (901, "", None), (None, rows[1][1], "x"), (1, rows[1][1], "x")])
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect() if r.doc_id is not None}
    assert found <= expected and len(found) >= 0.98 * len(expected) > 150
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == ({r[0] for r in rows} | {900, 901}) - {d for d, _ in found}


@pytest.mark.parametrize("n, texts", [(60, 1000), (450, 100), (1000, 50), (2000, 20)])
def test_decontamination_finds_long_items_with_all_edits(n, texts):
    chosen = random.Random(n)
    vocabulary = [f"w{i}" for i in range(20_000)]
    items = [chosen.choices(vocabulary, k=n) for _ in range(texts)]
    params = decontam.Cgk()
    index = decontam.build([(i, " ".join(words)) for i, words in enumerate(items)], params)
    numbers, ends = [], []
    for words in items:
        held = list(words)
        for at in sorted(chosen.sample(range(n), n // 10), reverse=True):
            held[at : at + 1] = [[], ["edit"], [held[at], "more"]][chosen.randrange(3)]
        around = chosen.choices(vocabulary, k=60)
        numbers += [index.numbers.get(w, 0) for w in [*around[:30], *held, *around[30:]]]
        ends.append(len(numbers))
    found = decontam.Finder(index, params).matches(np.array(numbers, np.int64), np.array(ends))
    assert sum(i in {number for number, _, _ in each} for i, each in enumerate(found)) >= 0.99 * texts


def test_decontamination_finds_short_items_and_scripts_without_spaces(spark):
    items = ["Short", "two words", "one two three four five six seven", "三人行必有我師", "การเรียนรู้ของเครื่อง" * 2, "三人", "", "., !"]
    docs = [
        "a SHORT, short text",
        "shorts and two more words",
        "so: One two-three four five six SEVEN.",
        "one two three four five six",
        "子曰:三人行,必有我師焉",
        "三x人 words two",
        "ก" + "การเรียนรู้ของเครื่อง" * 2 + "ใหม่",
        "two",
        "words",
        None,
        "one two three",
        "four five six seven",
        "x " + " ".join(["short"] * 3000),
    ]
    expected = set()
    for d, text in enumerate(docs):
        words = decontam.words_of(text)
        for i, item in enumerate(items):
            own = decontam.words_of(item)
            if own and distance(own, words) <= len(own) // 10:
                expected.add((d, i))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").coalesce(1)
    found = decontam.contaminated(rows, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected == {(0, 0), (2, 2), (4, 3), (4, 5), (6, 4), (12, 0)}
    assert len(found) == len(expected)
    assert [(r.end_word, r.n_words, r.distance) for r in found if r.item_id == 0] == [(2, 1, 0), (2, 1, 0)]
    assert {r.doc_id for r in decontam.clean(rows, bench).collect()} == set(range(13)) - {0, 2, 4, 6, 12}


def test_decontamination_in_blocks(spark, monkeypatch):
    items = [(i, prose(i, 20)) for i in range(6)]
    docs = spark.createDataFrame([(i, prose(50, 30) + " " + t + " " + prose(51, 30)) for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    whole = sorted(map(tuple, decontam.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 45)
    assert sorted(map(tuple, decontam.contaminated(docs, bench).collect())) == whole
    assert [(r[0], r[1], r[4]) for r in whole] == [(0, 0, 0), (0, 0, 0), *[(i, i, 0) for i in range(1, 6)]]
    assert decontam.contaminated(docs, bench.limit(0)).collect() == []
    assert decontam.contaminated(docs.limit(0), bench).collect() == []
    assert decontam.clean(docs, bench.limit(0)).count() == 6


# Licenses


def expand(parts, words):
    """All ends of matches of parsed template parts at the beginning of ``words``."""
    if not parts:
        return {0}
    first, rest = parts[0], parts[1:]
    if isinstance(first, str):
        return {1 + e for e in expand(rest, words[1:])} if words[:1] == [first] else set()
    if isinstance(first, int):
        return {n + e for n in range(first + 1) if n <= len(words) for e in expand(rest, words[n:])}
    return expand(rest, words) | expand([*first, *rest], words)


@pytest.mark.parametrize("seed", range(60))
def test_license_automata(seed):
    chosen = random.Random(seed)

    def template(depth):
        parts = [chosen.choice("abc")]
        for _ in range(chosen.randint(1, 4)):
            kind = chosen.randrange(4 if depth else 3)
            parts.append([chosen.choice("abc"), "{%d}" % chosen.randint(0, 3), chosen.choice("abc"), None][kind] or f"[{template(depth - 1)}]")
        chosen.shuffle(parts)
        return " ".join(parts)

    own = template(2)
    if not any(isinstance(p, str) for p in licenses.parse(own)):
        own = "a " + own
    words = chosen.choices("abc", k=25)
    expected = []
    for at in range(25):
        ends = {e for e in expand(licenses.parse(own), words[at:]) if e}
        if ends:
            expected.append(("x", at, at + max(ends)))
    assert list(licenses.Scanner({"x": own}).places(words)) == expected


def test_licenses(spark):
    texts = [
        None,
        "",
        "Licensed under the Apache License, Version 2.0.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under CC BY-NC 4.0. All rights\nreserved; all RIGHTS reserved.",
        "general public licenses, ALL righté reserved, cc-by-cc by",
        "x " * 20_000 + "Copyright (c) 2020 Jane Doe. All rights reserved",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[4]), (4, texts[4])], "doc_id long, text string")
    found = {r.doc_id: r.scan for r in licenses.scan(docs.withColumn("Scan", licenses.F.lit(0))).collect()}
    labels = {i: sorted({x.label for x in scan.licenses}) for i, scan in found.items()}
    assert labels[2] == ["apache-2.0"] and labels[3] == ["gpl-3.0", "gpl-any"] and labels[4] == ["cc-by-nc-4.0"]
    assert labels[0] == labels[1] == labels[5] == [] and labels[6] == ["copyright"] and labels[7] == ["mit"]
    assert [(x.label, x.start, x.end) for x in found[4].phrases] == [("cc-by", 2, 4), ("reserved", 7, 10), ("reserved", 10, 13)]
    assert [(x.label, x.start) for x in found[5].phrases] == [("cc-by", 6), ("cc-by", 8)]
    assert found[6].licenses[0].start == 20_000 and found[6].n_words == 20_008
    assert found[None] == found[4] and found[0].n_words == 0
    assert licenses.scan(docs.limit(0)).collect() == []


@pytest.mark.parametrize("lesser, version", [("", "2"), ("", "3"), ("Lesser ", "2.1"), ("Lesser ", "3")])
def test_license_published_notices(lesser, version):
    text = f"you can redistribute it and/or modify it under the terms of the GNU {lesser}General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    name = f"{'lgpl' if lesser else 'gpl'}-{version if '.' in version else version + '.0'}-notice"
    found = licenses.Scanner(licenses.TEMPLATES).places(licenses.tokens(text))
    assert [label for label, _, _ in found] == [name]


def test_license_scores(spark):
    """Whole texts and published notices 1, short notices 0.75, phrases alone 0.5."""
    apache = (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at\n\n    "
        "http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    )
    mozilla = (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    )
    texts = [apache, mozilla, apache[:60], mozilla[:-40], "Under the general public license.", "nothing", None]
    docs = licenses.scan(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"))
    scored = docs.select("*", licenses.score(F.col("scan.phrases"), F.col("scan.licenses")).alias("score"))
    rows = {r.doc_id: r for r in scored.collect()}
    assert [rows[i].score for i in range(7)] == [1.0, 1.0, 0.75, 0.75, 0.5, 0.0, 0.0]
    assert {x.label for x in rows[0].scan.licenses} == {"apache-2.0", "apache-2.0-notice"}
    assert {x.label for x in rows[1].scan.licenses} == {"mpl-2.0", "mpl-2.0-notice"}
    own = F.array(F.struct(F.lit("own").alias("label")))
    assert spark.range(1).select(licenses.score(F.array(), own)).first()[0] == 1.0
    assert not set(licenses.PHRASES) & set(licenses.TEMPLATES) and licenses.SHORT < set(licenses.TEMPLATES)
    whole = {label for label in licenses.TEMPLATES if label.endswith(("-text", "-notice"))}
    assert whole == set(licenses.TEMPLATES) - licenses.SHORT


@pytest.mark.parametrize("label", ["mit-text", "bsd-2-clause-text", "bsd-3-clause-text"])
def test_license_whole_texts(label):
    def labels(words):
        return {name for name, _, _ in licenses.Scanner(licenses.TEMPLATES).places(words)}

    words = [part for part in licenses.parse(licenses.TEMPLATES[label]) if isinstance(part, str)]
    opening = "mit" if label == "mit-text" else "bsd"
    assert labels(words) == {label, opening}
    assert labels([*words[:60], "added", *words[60:]]) == labels(words[:-1]) == {opening}


@pytest.mark.parametrize("bad", ["", "[a]", "a [b", "a ] b", "{3}"])
def test_license_templates_are_checked(bad):
    with pytest.raises(ValueError):
        licenses.compile_template(bad)


# Token files


TOKEN_TEXTS = [
    None,
    "",
    "Hello, world! It's 2024.",
    "<|endoftext|> x<|startoftext|>y A\nB <|ENDOFTEXT|> <| Endof",
    "I\u0307 A\u030a ΑΣ ΣΑΣ \u212a",
    "é e\u0301 Ａ\u00a0b\u2003c\u2028d\te\x1cf\x85g\r\nh",
    "don't we'll 'S\n\n  spaced   out  ",
    "\u0301 \u0301a a \u0301",
    "日本語 テキスト 한국어 \U0001f600\U0001f468\u200d\U0001f469",
    "x" * 20_000 + " " + "word " * 20_000,
    "Über, straße. ÿ ÆØ×÷ naïve, ½a aª word.. word,, a,b .word ,",
]


def test_tokens(spark):
    from tokenizers import Tokenizer

    rows = [(50 - i, t) for i, t in enumerate(TOKEN_TEXTS)] + [(None, "last"), (45, "twice"), (45, "twice"), (45, "a third")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", tokens.F.lit(0))
    path = scratch_path(spark, "tokens-test")
    tokens.write_tokens(docs.repartition(3), path)
    tokenizer = Tokenizer.from_file(tokens.tokenizer_path())
    expected = Counter()
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        expected[doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    found = tokens.digest(spark, path).orderBy("start").collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == expected
    order = [r.doc_id for r in found]
    assert order == sorted((d for d, _ in rows if d is not None)) + [None]
    assert [r.start for r in found] == [sum(r.n_tokens for r in found[:i]) for i in range(len(found))]
    stored = tokens.with_start(tokens.read_tokens(spark, path), path).collect()
    assert all(len(r.ids) == r.n_tokens and r.ids[-1] == 1 for r in stored)
    assert {(r.doc_id, r.start) for r in stored} == {(r.doc_id, r.start) for r in found}


def test_tokens_empty(spark):
    path = scratch_path(spark, "tokens-test")
    tokens.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path)
    assert tokens.digest(spark, path).collect() == []


def test_token_files_prune(spark):
    import pyarrow.orc as orc

    path = scratch_path(spark, "tokens-test")
    docs = spark.createDataFrame([(i, prose(i, 5)) for i in range(500)], "doc_id long, text string")
    tokens.write_tokens(docs, path)
    looked = tokens.read_tokens(spark, path).where("doc_id = 77").select("ids")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,77)]" in looked._jdf.queryExecution().toString()
    assert looked.count() == 1
    files = [p for p in spark.read.orc(path).inputFiles()]
    first = orc.ORCFile(files[0].removeprefix("file://").removeprefix("file:"))
    assert first.nstripes >= 1 and first.compression == "ZSTD"


def test_encoder_forgets_without_harm(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_PIECES", 10)
    encoder, texts = tokens.Encoder(tokens.tokenizer_path()), [prose(i, 8) for i in range(6)]
    direct = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    got = [encoder(pa.array([t]))[0].tolist() for t in texts]
    assert got == direct


def same_as_library(encoder, texts):
    ids, sizes = encoder(pa.array(texts, pa.string()))
    got = [each.tolist() for each in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_gives_words_to_the_model():
    """Words of letters, with marks or without, need no normalizer and no splitting; the ids are the same."""
    rnd = random.Random(10)
    encoder = tokens.Encoder(tokens.tokenizer_path())
    whole, seen = encoder.tokenizer, []

    class Spy:
        def encode_batch_fast(self, pieces, **options):
            seen.extend(pieces)
            return whole.encode_batch_fast(pieces, **options)

    encoder.tokenizer = Spy()
    words = ["".join(rnd.choices("abcdestßéÿÀÞ", k=rnd.randint(1, 9))) for _ in range(300)]
    text = " ".join(word + rnd.choice(["", "", ".", ",", "$$$", ".***", "'", "!?"]) for word in words)
    ids, sizes = encoder(pa.array([text, "", "x1"]))
    assert ids.tolist() == [i for t in (text, "x1") for i in whole.encode(t, add_special_tokens=False).ids]
    assert sizes[1] == 0
    assert not any(re.search("[a-zß-ÿÀ-Þ]", piece) for piece in seen if piece != "x1")
    alphabet = ["ab'sz", "ÀÉÞß", "A", ".,;'\"!$%_-", "0189½ª", " \n\t\r \u0085́", "日本ſKẞ"]
    encoder.tokenizer = whole
    same_as_library(
        encoder,
        ["".join(rnd.choice(rnd.choice(alphabet)) for _ in range(rnd.randint(0, 40))) for _ in range(2000)],
    )


@pytest.mark.parametrize("kind", ["added word", "marks in words", "letters apart", "upper case", "plain"])
def test_encoder_with_another_tokenizer(tmp_path, kind):
    """What the encoder takes for granted about letters and marks is looked up in the tokenizer."""
    from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers, trainers

    tokenizer = Tokenizer(models.BPE())
    tokenizer.normalizer = normalizers.Sequence([normalizers.NFD(), normalizers.Lowercase()])
    split = {"marks in words": "\\S+", "letters apart": "[a-m]+|[^a-m\\s]+"}.get(kind, "\\p{L}+|[^\\s\\p{L}]+")
    if kind == "upper case":
        tokenizer.normalizer = normalizers.Replace(Regex("[a-z]"), "X")
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(split), "removed", invert=True),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    trainer = trainers.BpeTrainer(
        vocab_size=400, initial_alphabet=pre_tokenizers.ByteLevel.alphabet(), show_progress=False
    )
    tokenizer.train_from_iterator([prose(i, 30) + " end. end, zenith$$$ été" for i in range(50)], trainer)
    if kind == "added word":
        tokenizer.add_tokens(["zenith"])
    tokenizer.save(str(tmp_path / "tokenizer.json"))
    encoder = tokens.Encoder(str(tmp_path / "tokenizer.json"))
    same_as_library(encoder, ["end. zenith$$$ zenith end,, of the été ô.", "", prose(7, 30)])
