"""The registered queries and their operators against plain Python over whole tables, or over small random fixtures."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import ann_search, html_extract, mixing, near_dedup, packing, quality_classifier, quality_rules, secret_scan, warc

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(spark, name, sf=SF):
    return [r.asDict() for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]


@tables
def test_warc_table(spark):
    pages = rows(spark, "pages")
    first = {}
    for r in pages:
        payload = (r["html"] or "").encode()
        first[payload] = min(first.get(payload, r["page_id"]), r["page_id"])
    want = []
    for r in pages:
        payload = (r["html"] or "").encode()
        again = first[payload] < r["page_id"]
        want.append((r["page_id"], len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response", first[payload] if again else None))
    got = [tuple(r)[:5] for r in warc.query(spark, SF).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_warc_revisits(spark, tmp_path):
    rng = random.Random(3)
    pages = [(i, f"u{i}", rng.choice(["", "a", "b" * 3000, None, f"own {i}"])) for i in range(300)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(7).write.parquet(f"{tmp_path}/pages.parquet")
    first = {}
    for i, _, h in pages:
        first.setdefault(h or "", i)
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.query(spark, str(tmp_path)).collect()}
    assert got == {i: ("response", None) if first[h or ""] == i else ("revisit", first[h or ""]) for i, _, h in pages}


PATTERNS = [
    ("assign", re.compile(r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII), 1, 12),
    ("access", re.compile(r"(AKIA[A-Z0-9]+)"), 1, 18),
    ("hex", re.compile(r"([0-9a-f]+)"), 1, 16),
]


def base_spans(text):
    spans = [(m.start(), k, m.end(), name) for k, (name, p, g, least) in enumerate(PATTERNS) for m in p.finditer(text) if len(m[g]) >= least]
    return sorted(spans)


@tables
def test_secret_base_spans(spark):
    want = {}
    sf = SF.replace("0.001", "0.01")  # the smallest table has no assignments
    for r in rows(spark, "documents", sf):
        spans = base_spans(r["text"] or "")
        digest = hashlib.sha256(",".join(f"{n}:{a}:{z}" for a, _, z, n in spans).encode()).hexdigest()
        kinds = Counter(n for *_, n in spans)
        want[r["doc_id"]] = (kinds["assign"], kinds["access"], kinds["hex"], digest, {f"{n}:{a}:{z}" for a, _, z, n in spans})
    out = secret_scan.query(spark, sf).collect()
    assert len(out) == len(want) and any(v[0] for v in want.values())
    for r in out:
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == want[r["doc_id"]][:4]
        assert want[r["doc_id"]][4] <= set(r["spans"].split(","))


def test_planted_random_strings_are_told_from_words_paths_and_dates(spark):
    """Precision and recall of the added spans on strings that the model has not seen."""
    rng = random.Random(5)
    vowels, others = "aeiou", "bcdfghlmnprstv"
    word = lambda: "".join(rng.choice(others) + rng.choice(vowels) for _ in range(rng.randint(2, 5)))
    key = lambda: base64.b64encode(rng.randbytes(30)).decode()[: rng.randint(28, 40)]
    texts, secrets = [], {}
    for i in range(300):
        parts = [word() for _ in range(60)] + [f"/usr/local/{word()}/{word()}/", f"20{rng.randint(10, 29)}-05-17_10-22-33_{word()}", f"{word()}_{word()}_{word()}", word().upper() + word().upper()]
        rng.shuffle(parts)
        if i % 3 == 0:
            secrets[i] = key()
            parts.insert(20, secrets[i])
        texts.append((i, " ".join(parts)))
    d = spark.createDataFrame(texts, "doc_id long, text string")
    model = secret_scan.fit(secret_scan.training_samples(d))
    found = {r["doc_id"]: [x["value"] for x in r["_spans"] if x["kind"] == 3] for r in secret_scan.scan(d, model).collect()}
    hits = sum(bool(v) and v[0] in secrets.get(i, "") for i, v in found.items())
    wrong = sum(len(v) for i, v in found.items() if i not in secrets)
    assert hits >= 0.95 * len(secrets) and wrong == 0


def exact_components(texts):
    sets = {}
    for i, t in texts.items():
        w = re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")
        w = WORD.findall(w)
        sets[i] = {tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if w else set()
    at = {i: i for i in sets}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    both = Counter()
    for ids in holders.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                both[a, b] += 1
    for (a, b), n in both.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            at[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@tables
def test_near_duplicates_of_the_table(spark):
    want = exact_components({r["doc_id"]: r["text"] for r in rows(spark, "documents")})
    out = near_dedup.query(spark, SF).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


@pytest.mark.parametrize(("large", "block"), [(64, 512), (4, 3)])
def test_near_duplicates_of_random_copies(spark, monkeypatch, large, block):
    """Copies of a few texts with more and more words changed, in random order, so that components hang together by chains; and a shared passage."""
    monkeypatch.setattr(near_dedup, "LARGE", large)
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", block)
    rng = random.Random(large)
    passage = [f"shared{k}" for k in range(40)]
    texts = []
    for family in range(12):
        words = [f"f{family}w{k}" for k in range(rng.choice([20, 60, 120]))]
        for _ in range(rng.choice([1, 5, 25])):
            words = [f"n{rng.random()}" if rng.random() < 0.03 else w for w in words]
            texts.append(" ".join(words + (passage if rng.random() < 0.5 else [])))
    texts += [" ".join(passage + [f"own{i}x{k}" for k in range(12)]) for i in range(40)] + [None, "", "one", "ONE", texts[0]]
    rng.shuffle(texts)
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(d).collect()}
    assert got == exact_components(dict(enumerate(texts)))


class Tree(HTMLParser):
    """A plain tree of well-formed pages: [tag, children], texts as strings."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = ["html", []]
        self.open = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag == "br":
            self.open[-1][1].append(" ")
            return
        node = [tag, []]
        self.open[-1][1].append(node)
        if tag not in html_extract.VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        if tag != "html":
            assert self.open.pop()[0] == tag

    def handle_data(self, data):
        self.open[-1][1].append(data)


def flat(node):
    """(characters, tags, link characters, link tags) of a node, recounted from its texts every time."""
    chars = tags = link_chars = link_tags = 0
    for k in node[1]:
        if isinstance(k, str):
            chars += len(k.strip())
        else:
            c, t, lc, lt = flat(k)
            chars, tags, link_chars, link_tags = chars + c, tags + t + 1, link_chars + lc, link_tags + lt + (k[0] == "a")
    return (chars, tags, chars, tags) if node[0] == "a" else (chars, tags, link_chars, link_tags)


def plain_main_text(page):
    root = Tree(page).root
    body = flat(root)

    def density(node):
        c, t, lc, lt = flat(node)
        if not c:
            return 0.0
        t1, lc1, lt1 = max(1, t), max(1, lc), max(1, lt)
        base = math.log(c * lc / max(1, c - lc) + body[2] / max(1, body[0]) * c + math.e)
        return c / t1 * math.log(max(1.0, c / lc1 * t1 / lt1)) / math.log(base + math.e - 1)

    def total(node):
        own = density(node) if any(isinstance(k, str) and k.strip() for k in node[1]) else 0.0
        return sum(density(k) for k in node[1] if not isinstance(k, str)) + own

    paths = []

    def walk(node, path):
        paths.append([*path, node])
        for k in node[1]:
            if not isinstance(k, str):
                walk(k, [*path, node])

    walk(root, [])
    path = max(paths, key=lambda p: total(p[-1]))  # the first of equals
    least = min(density(n) for n in path)
    out = []

    def text(node):
        run = ""
        for k in node[1]:
            if isinstance(k, str):
                run += k
            elif k[0] in html_extract.BLOCKS:
                out.append(run)
                run = ""
                text(k)
            else:
                before = len(out)
                inner = Tree("").root
                inner[1] = k[1]
                text(inner)
                pieces = out[before:]
                del out[before:]
                run += pieces[0]
                if len(pieces) > 1:
                    out.append(run)
                    out.extend(pieces[1:-1])
                    run = pieces[-1]
        out.append(run)

    def keep(node, depth):
        if node is path[-1] or depth < len(path) and node is not path[depth] and density(node) >= least > 0:
            text(node)
        elif depth < len(path) and node is path[depth]:
            for k in node[1]:
                if not isinstance(k, str):
                    keep(k, depth + 1)

    keep(root, 0)
    return "\n".join(s for s in (" ".join(x.split()) for x in out) if s)


def random_page(rng):
    def words(n):
        return " ".join(rng.choice(["alpha", "beta,", "gamma &amp; delta", "epsilon.", "&#233;t&eacute;"]) for _ in range(n))

    def node(depth):
        kind = rng.random()
        if depth > 4 or kind < 0.4:
            return f"<p>{words(rng.randint(1, 40))}{'<br>' if rng.random() < 0.2 else ''} {'<b>' + words(2) + '</b>' if rng.random() < 0.3 else ''}</p>"
        if kind < 0.55:
            return "<ul>" + "".join(f'<li><a href="/x">{words(2)}</a></li>' for _ in range(rng.randint(1, 6))) + "</ul>"
        if kind < 0.65:
            return f"<div>{words(rng.randint(5, 60))}</div>"
        return "<div>" + "\n".join(node(depth + 1) for _ in range(rng.randint(1, 5))) + "</div>"

    return "<html><body>" + "".join(node(0) for _ in range(rng.randint(1, 6))) + "</body></html>"


def test_main_text_of_random_pages():
    rng = random.Random(11)
    for _ in range(150):
        page = random_page(rng)
        assert html_extract.main_text(page) == plain_main_text(page), page


@pytest.mark.parametrize(
    "page",
    ["<div>" * 10_000 + "text" + "</div>" * 10_000, '<a "' * 250_000, '<a ">" ' * 100_000, "<a" * 300_000 + '">"', "<![CDATA[" * 100_000, "<div>" * 50_000 + "</b>" * 50_000,
     "<span>" * 50_000 + "<p>x</p>" * 50_000, "<li><ul>" + "<span>" * 50_000 + "<li>x</li>" * 50_000, "<article>" * 50_000 + "x", "<!-- " * 200_000, "<div " + 'class="' * 100_000 + ">x"],
)
def test_hostile_pages_take_time_in_proportion(page):
    import time

    began = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - began < 15


@tables
def test_quality_counts_of_the_table(spark):
    got = {r["doc_id"]: r for r in quality_rules.query(spark, SF).collect()}
    docs = rows(spark, "documents")
    assert len(got) == len(docs)
    for r in docs:
        t = r["text"] or ""
        w = WORD.findall(t)
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeated = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated))
        g = got[r["doc_id"]]
        assert tuple(g[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        assert g["base_failed"] == failed and not (failed and g["kept"])


def test_robust_estimate_against_many_starts(spark):
    """The estimate's distances part outliers from the rest as the best of many random starts does."""
    rng = np.random.default_rng(4)
    clean = rng.multivariate_normal([150, 20, 30, 40, 60], np.diag([400.0, 900, 1600, 2500, 900]) + 150, 900)
    junk = rng.normal(size=(100, 5)) * 20 + [150, 420, 500, 300, 60]
    x = np.round(np.vstack([clean, junk]))
    floors, h = np.diag(np.square(quality_rules.FLOORS)), math.ceil(quality_rules.SHARE * len(x))

    def distances(rows):
        c = quality_rules.CONSISTENT * np.cov(rows.T, bias=True) + floors
        d = x - rows.mean(0)
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d), np.linalg.slogdet(c)[1]

    best = None
    for _ in range(60):
        rows_ = x[rng.choice(len(x), 8, replace=False)]
        for _ in range(12):
            d2, size = distances(rows_)
            rows_ = x[np.argsort(d2)[:h]]
        d2, size = distances(rows_)
        if best is None or size < best[1]:
            best = d2, size
    d = spark.createDataFrame([("=en", "=a", *map(float, r)) for r in x], "lk string, sk string, " + ", ".join(f"{c} double" for c in quality_rules.X))
    d = d.withColumn("i", F.monotonically_increasing_id())
    got = np.array([r["d2"] for r in quality_rules.with_distance(d, quality_rules.fit(d)).orderBy("i").collect()])
    assert ((got > quality_rules.CUT) == (best[0] > quality_rules.CUT)).mean() > 0.99
    assert (got[900:] > quality_rules.CUT).all() and (got[:900] > quality_rules.CUT).mean() < 0.01
    assert np.corrcoef(np.log1p(got), np.log1p(best[0]))[0, 1] > 0.999


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    fixed = {}
    while True:
        left = sum(sizes.values()) - sum(fixed.values())
        free = [s for s in order if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_targets_of_random_sources():
    rng = random.Random(2)
    for _ in range(200):
        sizes = {s: rng.choice([0, rng.randint(1, 100), rng.randint(1, 10**6)]) for s in [*map(str, range(rng.randint(1, 12))), None]}
        if any(sizes.values()):
            assert mixing.targets(sizes) == pytest.approx(plain_targets(sizes))


@tables
def test_mix_of_the_table(spark):
    docs = rows(spark, "documents")
    sizes = Counter()
    for r in docs:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    goal = plain_targets(sizes)
    out, taken = mixing.query(spark, SF).collect(), Counter()
    assert sorted((r["doc_id"], r["size"]) for r in out) == sorted((r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in docs)
    for r in out:
        assert r["target"] == pytest.approx(goal[r["source"]]) and r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, n in goal.items():
        assert abs(taken[s] - n) <= 3 * mixing.BLOCK + 0.01 * n


def test_mix_with_a_late_shard_and_rows_without_id(spark):
    texts = [(None if i % 2 else i, " ".join(f"w{k}" for k in range(50 + i % 40)), "en", ["big", "big", "small", None][i % 4], 0) for i in range(400)]
    d = spark.createDataFrame(texts, COLUMNS).withColumns({c: F.lit("clash") for c in ("row", "pass", "runs", "low", "block")})
    out = mixing.mix(d, block=4, slots=64).toPandas()
    per = out.groupby(out["source"].fillna("-"))[["size", "taken"]].sum()
    goal = plain_targets({s if s != "-" else None: n for s, n in per["size"].items()})
    for s, r in per.iterrows():
        assert abs(r["taken"] - goal[None if s == "-" else s]) <= 16
    mixed = mixing.stage(spark, d, "")
    assert mixed.columns == d.columns and mixed.filter("row <> 'clash'").count() == 0


def pieces_hold(out, tokens):
    """Every id in exactly one piece, pieces gapless from 0 within sequences, sequences full but for the last."""
    by_doc = defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
    assert set(by_doc) == set(tokens)
    for i, ids in tokens.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    fill, last = Counter(), max(r["sequence_id"] for r in out)
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert all(n == 2048 for s, n in fill.items() if s != last) and fill[last] <= 2048 and len(fill) == last + 1


@tables
def test_packing_of_the_table(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.default_tokenizer())
    tokens = {r["doc_id"]: np.array([*model.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4") for r in rows(spark, "documents")}
    pieces_hold(packing.query(spark, SF).collect(), tokens)


def test_rounds_of_random_sources():
    rng = np.random.default_rng(0)
    for trial in range(60):
        totals = {f"s{i}": int(rng.integers(1, 200_000)) for i in range(rng.integers(1, 7))}
        plan = packing.Rounds(totals, weights={s: float(rng.integers(0, 5)) for s in totals} if trial % 2 else None)
        seen = []
        for s, total in totals.items():
            cuts = np.unique(np.concatenate([[0, total], rng.integers(0, total + 1, 40)]))
            _, _, size, where = plan.pieces(np.full(len(cuts) - 1, plan.order[s]), cuts[:-1], np.diff(cuts))
            assert size.sum() == total and (size > 0).all()
            seen += zip(where.tolist(), size.tolist())
        at = 0
        for where, size in sorted(seen):
            assert where == at and where // 2048 == (where + size - 1) // 2048
            at += size


def test_rounds_keep_target_weights():
    plan = packing.Rounds({"a": 3_000_000, "b": 2_000_000, "c": 1_000_000}, weights={"a": 1, "b": 1, "c": 2})
    sent = plan.sent(np.arange(0, 970, 97))
    assert np.abs(np.diff(sent, axis=1) / (97 * 2048) - np.array([[0.25], [0.25], [0.5]])).max() < 0.01


def test_products_beyond_64_bits():
    rng = random.Random(1)
    for _ in range(500):
        n = rng.randrange(1, 1 << 41)
        x, y = rng.randrange(0, n + 1), rng.randrange(0, 1 << 41)
        less = int(x * y > 0) * rng.randrange(2)
        assert int(packing.muldiv(np.array([x]), np.array([y]), np.array([n]), less)[0]) == (x * y - less) // n


@tables
def test_classifier_on_the_table(spark, tmp_path):
    """Held-out accuracy; the labels of held-out rows, sources and ids take no part."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    out = quality_classifier.score(docs, quality_classifier.train(docs, labels)).toPandas()
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in out["doc_id"]])
    assert (out["held_out"].to_numpy() == held).all() and out["score"].between(0, 1).all()
    truth = labels.toPandas().set_index("doc_id")["quality"]
    test = out[held & out["doc_id"].isin(truth.index)]
    assert ((test["score"] >= 0.3).astype(int) == test["predicted"]).all()
    assert (test["predicted"].to_numpy() == truth[test["doc_id"]].to_numpy()).mean() > 0.9
    flipped = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumns({"lang": F.lit("x"), "source": F.lit(None).cast("string")})
    again = quality_classifier.score(other, quality_classifier.train(other, flipped)).toPandas()
    assert np.array_equal(out.sort_values("doc_id")["score"].to_numpy(), again.sort_values("doc_id")["score"].to_numpy())


def test_sample_is_bounded_by_n_grams(spark):
    rows_ = [(k, i, bytes(4 * 100), i % 2, 0.5) for k, i in enumerate([*range(40), 3, 3])]
    f = spark.createDataFrame(rows_, "u long, doc_id long, grams binary, label int, share double")
    out = quality_classifier.bounded(f, 1000).collect()
    assert sorted(r["label"] for r in out) == [0] * 10 + [1] * 10 and len({r["doc_id"] for r in out}) == 20


def vectors(kind, rng, n=1200, dim=24):
    g = rng.normal(size=(n, dim))
    unit = g / np.linalg.norm(g, axis=1, keepdims=True)
    centres = rng.normal(size=(30, dim)) * 2
    outlier = g.copy()
    outlier[:3] *= 1000
    return {"unit": unit, "gauss": g, "lognormal": g * np.exp(rng.normal(size=(n, 1))), "clusters": centres[rng.integers(30, size=n)] + 0.4 * rng.normal(size=(n, dim)), "outlier": outlier, "huge": g * 1e18}[kind]


@pytest.mark.parametrize("kind", ["unit", "gauss", "lognormal", "clusters", "outlier", "huge"])
def test_recall_for_vectors_of_any_length(spark, kind):
    x = vectors(kind, np.random.default_rng(8)).astype(np.float32)
    d = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    out = ann_search.search(d, F.col("vec_id") % 20 == 0, shard_rows=500).toPandas()
    s = x[::20].astype(float) @ x.astype(float).T
    hits = 0
    for k in range(len(s)):
        s[k, 20 * k] = -np.inf
        g = out[out["query_id"] == 20 * k].sort_values("rank")
        want = np.lexsort((np.arange(len(x)), -s[k]))[:20]
        hits += len(set(want) & set(g["vec_id"]))
        assert g["rank"].tolist() == list(range(1, 21)) and np.allclose(g["score"], s[k, g["vec_id"]], rtol=1e-9, atol=0)
    assert hits / (20 * len(s)) >= 0.9 and (out["shard_recall"] >= ann_search.GOAL).all()
