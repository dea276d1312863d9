"""The pipeline's operators against brute force, round trips and held-out rows, with nulls, empties, ties and clashing columns."""

import collections
import hashlib
import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkslab.llm import decontaminate, html, jaccard, langid, lines, media, mincut, mixing, queries, shingles, simple8b, tokens, toxicity, warc

WORDS = [f"w{i}" for i in range(300)]
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, a shared line, odd texts, a repeated row, null ids, and columns with clashing names."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(6, 120)) for _ in range(60)]
    for i in range(12):
        near = texts[i].split()
        near[len(near) // 2] = "changed"
        texts += [texts[i], " ".join(near)]
    base = prose(rng, 200).split()
    for _ in range(25):  # a group of near copies, larger than a small node
        t = list(base)
        t[rng.randrange(200)] = rng.choice(WORDS)
        texts.append(" ".join(t))
    texts += [None, "", "   ", "one two", "one two", "é" * 3000, prose(rng, 4000), "shared boilerplate line\n" + prose(rng, 10)]
    texts += ["shared boilerplate line\n" + prose(rng, 10) for _ in range(9)]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 7}" if i % 11 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], (None, "text without id", None, None, 0)]
    df = spark.createDataFrame(rows, DOC)
    return df.withColumns({"score": F.lit("x"), "h": F.lit(1), "rid": F.lit(2), "z": F.lit(3)}).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.mark.parametrize("top", [1, 2, 50_000, 2**40, 2**63])
@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
def test_simple8b(n, top):
    v = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64)
    v[n // 3 : n // 2] = 0
    words, offsets = simple8b.encode(v)
    assert (simple8b.decode(words, offsets, n) == v).all()
    if n > 512:  # a block by itself
        assert (simple8b.decode(words[: offsets[1]], offsets[:2], 512) == v[:512]).all()


def test_tokens(spark, corpus, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file()
    whole = Tokenizer.from_file(path)
    odd = ["<|endoftext|> a.<|startoftext|>b", "it's a 12,5. don't. ", "ΑΣ. ὈΔΥΣΣΕΎΣ, İstanbul, ﬁne.", "日本語。テキスト, 한국어.", "\t tab\x0b x y,", "A.,B.. ,,.. ..,", None, "", "X" * 100 + ","]
    e = tokens.Encoder(path)
    for t in odd:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == whole.encode(t or "", add_special_tokens=False).ids
    rng = random.Random(12)
    hard = "aAzZ09.,,..'<|>  \t\n\u0130\u0131\u0307\u0301\u00c9\u00e9\u1e9e\u03a3\u03c2\u00a0\u2009\u3000\u200b\ufb1d\u05b4\ufb01\u1100\u1161\u65e5\u0660\u00b2\u2164\U0001f600\U00010400"
    e = tokens.Encoder(path)
    assert e.by_piece
    for i in range(20_000):
        t = "".join(rng.choice(hard) for _ in range(rng.randint(1, 12)))
        assert np.frombuffer(e.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(tokens, "CACHE_WORDS", 50)  # pieces are dropped and found again
        for _ in range(2000):
            t = " ".join(rng.choice(WORDS) + rng.choice(["", ",", ".", "\u0130."]) for _ in range(9))
            assert np.frombuffer(e.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids
    other = tokens.Encoder(queries.tokenizer_file("byte_bpe_50k.json"))  # blanks count there, so texts go whole
    t = "  Two  words,\nand more. "
    assert not other.by_piece and np.frombuffer(other.encode(t), "<u4").tolist() == other.tokenizer.encode(t, add_special_tokens=False).ids
    got = sorted(tokens.token_output(corpus, path).collect(), key=lambda r: r.start)
    want = sorted(((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in corpus.collect()), key=lambda x: x[0])
    assert [r.doc_id if r.doc_id is not None else -1 for r in got] == [i for i, _ in want]
    start = 0
    for r, (_, t) in zip(got, want, strict=True):
        ids = [*whole.encode(t, add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokens.token_output(empty, path).count() == 0


def test_language(spark, small, corpus, empty):
    docs = queries.table(spark, small, "documents")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r for r in langid.identify(corpus).collect()}
    assert all(odd[r.doc_id].lang_pred == "und" for r in corpus.where("text is null or trim(text) = ''").collect())
    assert langid.identify(empty).count() == 0
    v = langid.GramVectors()
    some = [langid.grams("the cat"), langid.grams(""), langid.grams("Çà et là")]
    assert np.allclose(v.bundles(some), [v.bundle(*g) for g in some])


def test_lines(spark, corpus, empty):
    rows = corpus.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in lines.remove_boilerplate(rows).collect()}
    sites = collections.defaultdict(set)
    for r in rows.collect():
        for x in (r.text or "").split("\n"):
            if x.strip(" ") and r.source is not None:
                sites[x.strip(" ")].add(r.source)
    gone = {x for x, s in sites.items() if len(s) >= lines.SITES}
    assert "shared boilerplate line" in gone
    for r in rows.collect():
        kept = "\n".join(x for x in (r.text or "").split("\n") if x.strip(" ") not in gone)
        assert got[r.doc_id].text_md5 == hashlib.md5(kept.encode()).hexdigest()
    assert lines.remove_boilerplate(corpus).count() == corpus.count() and lines.remove_boilerplate(empty).count() == 0


def test_mixing(spark, corpus, empty):
    rows = corpus.collect()
    units = mixing.plan(corpus, block_tokens=300).collect()
    assert sum(r.copies for r in units) == len(rows) and all(r.whole >= 1 and 0 <= r.extra <= r.copies for r in units)
    size, used, weight, count = collections.Counter(), collections.Counter(), {}, lambda t: len((t or "").split())
    for r in rows:
        size[r.source] += count(r.text)
    for r in units:
        used[r.source] += r.n_tokens * (r.copies * r.whole + r.extra)
        weight[r.source] = r.weight
    # the weights are the shares to a power: the smallest power with which no source is repeated more than twice as often as another
    total = sum(size.values())
    a = min(x / 4096 for x in range(4097) if (lambda m: max(m) / min(m) <= mixing.MAX_REPEATS + 1e-9)([(n / total) ** (x / 4096 - 1) for n in size.values()]))
    q = {s: (n / total) ** a for s, n in size.items()}
    assert all(abs(weight[s] - q[s] / sum(q.values())) < 1e-3 for s in size)
    spend, largest = max(size[s] / weight[s] for s in size), max(r.n_tokens for r in units)
    for s in size:  # within one document of the target
        assert -1e-6 <= weight[s] * spend - used[s] <= largest + 1
    # the schedule by brute force: every pass is a permutation, the last one is a prefix of its own
    uses = mixing.schedule(corpus, block_tokens=300).collect()
    times = collections.Counter((r.doc_id, r.source, r.n_tokens) for r in uses)
    want = collections.Counter()
    for r in units:
        want[r.doc_id, r.source, r.n_tokens] += r.copies * r.whole + r.extra
    assert times == want
    by = collections.defaultdict(list)
    for r in uses:
        by[r.source, r["pass"]].append(r)
    for (s, k), mine in by.items():
        blocks = {r.place for r in mine}
        assert blocks == set(range(1, len(blocks) + 1))
        if (s, k + 1) in by:  # a whole pass has every row of the source once
            assert collections.Counter(r.doc_id for r in mine) == collections.Counter(r.doc_id for r in rows if r.source == s)
    orders = {k: [r.doc_id for r in sorted(by["s1", k], key=lambda r: (r.place, r.turn, r.doc_id))] for s, k in by if s == "s1"}
    assert len(orders) < 2 or orders[0][: len(orders[1])] != orders[1]
    odd = corpus.withColumns({"_rid": F.lit(1), "_repeats": F.lit(2), "times": F.lit(3), "copies": F.lit(4), "use": F.lit(5)})
    out = mixing.mixed(odd, block_tokens=300)
    assert out.columns == odd.columns
    assert collections.Counter((r.doc_id, r.source, count(r.text)) for r in out.collect()) == want
    # ties: equal rows at the edge of the budget are used in part, and every run alike
    twins = spark.createDataFrame([(1, "a b c d", "s")] * 10 + [(2, "a b c d", "s")], "doc_id long, text string, source string")
    for _ in range(2):
        assert mixing.mixed(twins, budget=58).count() == 11 + 3
    assert sum(r.copies * r.whole + r.extra for r in mixing.plan(twins, budget=58).collect()) == 14
    src = spark.createDataFrame([("a", 800.0, 1000.0), ("b", 150.0, 1000.0), ("c", 50.0, 1000.0)], "source string, tokens double, total double")
    a = mixing.bisect_exponent(src, entropy=0.9)
    q = np.array([0.8, 0.15, 0.05]) ** a
    q /= q.sum()
    assert abs(-(q * np.log(q)).sum() - 0.9) < 1e-6
    assert mixing.plan(empty).count() == 0


def test_toxicity(spark, corpus, empty):
    rng = random.Random(1)
    rows = [(i, prose(rng, 20) + (" insultword groupword" if i % 3 == 0 else " insultword" if i % 3 == 1 else " groupword")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 5) for i, _ in rows] + [(1, None, 5), (None, 1, 5)], "doc_id long, toxic int, score int")
    got = toxicity.toxicity(docs, labels).where("held_out").collect()
    assert np.mean([r.predicted == int(r.doc_id % 3 == 0) for r in got]) > 0.95  # the pair, not either word
    out = toxicity.toxicity(corpus, labels)
    assert out.count() == corpus.count() and all(0 <= r.score <= 1 for r in out.collect())
    assert toxicity.toxicity(empty, labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs.limit(3), labels.limit(0)).collect()} == {0.5}


def test_machine_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(3)
    m = toxicity.Machine(0.3, np.arange(6), rng.normal(size=6), rng.normal(size=(6, 4)))
    docs = [np.array(sorted(rng.choice(6, k, replace=False)), dtype=np.int64) for k in (0, 1, 2, 5, 6)]
    want = [0.3 + sum(m.weights[i] for i in d) + sum(m.factors[i] @ m.factors[j] for i in d for j in d if i < j) for d in docs]
    assert np.allclose(m.logits(docs), want)
    # the gradient that the fit follows lowers the loss it is meant for
    y = np.array([0, 0, 1, 1, 0.0])
    loss = lambda m: float(np.logaddexp(0, m.logits(docs) * (1 - 2 * y)).sum())
    assert loss(toxicity.fit_machine(docs, y, m.terms, steps=200)) < 0.1 * loss(toxicity.fit_machine(docs, y, m.terms, steps=0))


def test_toxicity_of_a_term_that_says_nothing_alone(spark):
    """A group is in as many toxic documents as the average, but beside an insult it decides."""
    rng = random.Random(2)
    kinds = [("insultword groupword", 1)] * 100 + [("insultword", 0)] * 100 + [("groupword", 0)] * 300 + [("otherword", 1)] * 100 + [("", 0)] * 200
    rows = [(i, f"{prose(rng, 15)} {t}", y) for i, (t, y) in enumerate(kinds * 2)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    sample = docs.join(labels, "doc_id").select("text", "toxic")
    alone = toxicity._differing(sample)
    group = toxicity._hash("groupword")
    linear = toxicity.fit_machine(*toxicity._placed(sample, alone), alone, factors=0)
    assert group not in alone and toxicity._hash("insultword") in alone and group in toxicity._beside(sample, linear)
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).where("held_out").collect()}
    assert np.mean([got[i] == y for i, t, y in rows if i in got and "insultword" in t]) > 0.95


def test_toxicity_of_one_particular_partner(spark):
    """A group decides beside one insult and, the other way round, beside another, so that beside any of them it says nothing."""
    rng = random.Random(8)
    kinds = [("firstword groupword", 1)] * 120 + [("firstword", 0)] * 120 + [("secondword groupword", 0)] * 120 + [("secondword", 1)] * 120 + [("groupword", 0)] * 150 + [("", 0)] * 500
    rows = [(i, f"{prose(rng, 12)} {t}", y) for i, (t, y) in enumerate(kinds)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    sample = docs.join(labels, "doc_id").select("text", "toxic")
    alone = toxicity._differing(sample)
    docs_at, y = toxicity._placed(sample, alone)
    linear = toxicity.fit_machine(docs_at, y, alone, factors=0)
    sums = {}  # by brute force
    for text, label in sample.collect():
        mine = {h for w in toxicity.words(text) for h in toxicity.word_terms(w)}
        at = [i for i, t in enumerate(alone.tolist()) if t in mine]
        p = 1 / (1 + math.exp(-(linear.bias + sum(linear.weights[i] for i in at))))
        for c in at if p * (1 - p) >= toxicity.UNSURE else []:
            for t in mine:
                n, e, v = sums.get((c, t), (0, 0, 0))
                sums[c, t] = n + 1, e + label - p, v + p * (1 - p)
    want = sorted({t for (_, t), (n, e, v) in sums.items() if n >= toxicity.MIN_DOCS and abs(e) >= toxicity.MIN_Z * v**0.5})
    assert toxicity._beside(sample, linear).tolist() == want and toxicity._hash("groupword") in want
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).where("held_out").collect()}
    assert np.mean([got[i] == y for i, t, y in rows if i in got and ("firstword" in t or "secondword" in t)]) > 0.95


def test_language_by_brute_force(spark):
    """Letter by letter: bind, bundle, compare."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat", "en"), ("on the mat", "en"), ("der hund lief", "de"), ("im wald der", "de"), ("Été à", "fr"), (None, "en"), ("42", "de"), ("the dog", None)])]
    docs = spark.createDataFrame([(*r, r[0] % 4 == 1) for r in rows], "doc_id long, text string, lang string, held_out boolean")
    d, vectors = 128, {}

    def letter(c):
        if c not in vectors:
            vectors[c] = 2.0 * np.random.default_rng([langid.SEED, ord(c)]).integers(0, 2, d) - 1
        return vectors[c]

    def bundle(text):
        plain = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        padded = f" {' '.join(plain.split())} " if plain.strip() else ""
        out = np.zeros(d)
        for i in range(len(padded) - 2):
            out += np.prod([np.roll(letter(c), 2 - k) for k, c in enumerate(padded[i : i + 3])], axis=0)
        return out

    sums = collections.defaultdict(lambda: np.zeros(d))
    for _, t, lang in rows:
        if lang:
            sums[lang] += bundle(t)
    prototypes = langid.learn_prototypes(docs, d)
    assert set(prototypes) == set(sums) and all(np.allclose(prototypes[k], v / np.linalg.norm(v), atol=1e-6) for k, v in sums.items())
    got = {r.doc_id: r for r in langid.predict(docs, prototypes, d).collect()}
    for i, t, _ in rows:
        v = bundle(t)
        cosine = {k: float(p @ v) / max(np.linalg.norm(p) * np.linalg.norm(v), 1e-12) for k, p in sums.items()}
        best = max(sorted(cosine), key=cosine.get) if v.any() else "und"
        assert got[i].lang_pred == best and abs(got[i].score - min(max(cosine.get(best, 0.0), 0.0), 1.0)) < 1e-5


def test_mincut_is_the_cheapest_labelling():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 7)
        keep, drop = ([rng.choice([0, 1, 2.5, 4]) for _ in range(n)] for _ in "ab")
        edges = [(i, j, rng.choice([0.5, 1, 3])) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda x: sum(k if c else d for c, k, d in zip(x, keep, drop)) + sum(w for i, j, w in edges if x[i] != x[j])  # noqa: E731, B023
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(mincut.labels(keep, drop, edges)) - best) < 1e-9


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav>
<header class="site">Logo</header><div class="cookie-notice">We use cookies, please accept all of them now.</div>
<article><h1>A &amp; B</h1><p><b>First  paragraph &copy; of the
text<br>goes on.<p>Second.</article><script>if (a<b) document.write("<p>no</p>")</script>
<section id="comments"><p>I think that this is a long comment with many words in it, really.</p></section><footer>f</footer>"""
    assert html.main_text(page) == "A & B\nFirst paragraph © of the text goes on.\nSecond."
    pages = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, None), (None, "u", ""), (4, "u", "<p>" + "long text. " * 20000)], "page_id long, url string, html string")
    got = html.extract(pages.withColumn("text", F.lit(1))).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got)[:2] == [(0, 0), (1, 52)] and max(r.n_chars for r in got) == 20000 * 11 - 1
    assert html.extract(pages.limit(0)).count() == 0


def test_html_without_end_of_head():
    body = "<article><p>First paragraph of the text.<p>Second.</article>"
    for start in ("<body>", "", "<main>"):
        head = "<!DOCTYPE html><html><head><meta charset=utf-8><title>T</title><style>p{}</style><template><p>Not shown at all.</p></template>"
        assert html.main_text(head + start + body) == html.main_text(head + "</head>" + start + body) == "First paragraph of the text.\nSecond."


def test_html_cut_decides_where_blocks_say_little():
    """A page without telling names or elements: the cut flips short lines of the text in, and of the menu out."""
    long = "This sentence goes on with many plain words so that it is a paragraph of the text, as any reader sees at once."
    menu = "".join(f"<div><a href=x>Place {i}</a></div>" for i in range(6))
    page = f"<body><div>{menu}<div>Read all news now.</div>{menu}</div><div><div>{long}</div><div>Then this</div><div>{long} {long}</div><div>and that</div><div>{long}</div></div><div>{menu}</div>"
    found = html.blocks(page)
    keep, drop, edges = html.graph(found)
    alone = [d > k for k, d in zip(keep, drop)]
    cut = mincut.labels(keep, drop, edges)
    truth = [not b.linked and not b.text.startswith("Read") for b in found]
    assert cut == truth and sum(x != y for x, y in zip(alone, truth)) >= 2
    assert html.main_text(page) == "\n".join([long, "Then this", f"{long} {long}", "and that", long])


def test_html_names_are_evidence_not_verdicts():
    long = "This sentence goes on with many plain words so that it is a paragraph of the text, as any reader sees at once."
    for start in ('<div class="post comments-open">', '<div id="page-header-wrap">', '<article><section id="related">', '<div class="no-sidebar">', '<form action=x><div class="content">'):
        assert html.main_text(f"<body>{start}<p>{long}</p><p>{long}</p>") == f"{long}\n{long}", start
    for start in ('<div class="comments-area">', '<div class="site-footer">', "<aside>", '<div class="ad">', '<section id="comments">', '<div class="cookieNotice">'):
        assert html.main_text(f"<body><article><p>{long}</p></article>{start}<p>{long}</p>") == long, start


@pytest.mark.parametrize("page", ["<b " * 350_000, "<div>x" * 170_000, "<p>a<li>b" * 110_000, '<a href="x> y ' * 70_000, "<div>" * 30_000 + "</p>x" * 170_000, "<b>" + "<i>" * 50_000 + "</b>x" * 170_000, "<script></script " * 60_000, "<ul><li>a b c." * 70_000, "<!-- x " * 150_000, "<p>Read on now.</p><li><a href=x>link here</a></li>" * 20_000])
def test_html_of_a_megabyte_ends(page):
    began = time.process_time()
    html.main_text(page)
    assert time.process_time() - began < 60


def brute_windows(text, item):
    shingle = lambda t: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if (w := (t or "").lower().split()) else []
    x, y = shingle(text), shingle(item)
    best = 0.0
    for s in range(max(1, len(x) - len(y) + 1)) if x and y else []:
        a, b = collections.Counter(x[s : s + len(y)]), collections.Counter(y)
        both = sum((a & b).values())
        best = max(best, both / (sum(a.values()) + len(y) - both))
    return best


def test_decontamination(spark, corpus, empty):
    rng = random.Random(3)
    items = [(i, prose(rng, rng.randint(14, 50))) for i in range(12)] + [(50, "too short"), (51, None), (52, "")]
    texts = []
    for k in range(60):
        w = items[k % 12][1].split()
        if k % 3 == 1:
            w[rng.randrange(len(w))] = "zzz"
        if k % 3 == 2:
            w.insert(rng.randrange(len(w)), "zzz")
        texts.append((1000 + k, prose(rng, rng.randint(0, 30)) + " " + " ".join(w) + "  " + prose(rng, rng.randint(0, 30))))
    docs = spark.createDataFrame(texts + [(2000, "Too  SHORT"), (2001, None), (2002, items[0][1])], "doc_id long, text string").unionByName(corpus.select("doc_id", "text"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(docs, bench).collect()}
    want = {(r.doc_id, i): s for r in docs.where("doc_id is not null").collect() for i, t in items if (s := brute_windows(r.text, t)) >= 0.8}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 25
    assert decontaminate.clean(docs, bench).where("doc_id in (2000, 2002)").count() == 0
    assert decontaminate.clean(corpus, bench).columns == corpus.columns
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_finds_short_items_in_longer_documents(spark):
    items = [(1, "Alpha"), (2, "beta  gamma"), (3, "one two three"), (4, "a b c d"), (5, "beta delta"), (6, None)]
    docs = [(1, "x beta gamma y z alpha w"), (2, "one two three"), (3, "u v w a b C d e f g"), (4, "a b c"), (5, "beta x delta alphabet one two 3"), (6, ""), (7, None)]
    bench, texts = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.similarity) for r in decontaminate.contaminated(texts, bench).collect()}
    assert got == {(1, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0)}


def test_near_keys_find_all_within_the_radius(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(40):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, decontaminate.RADIUS)):
            y ^= 1 << b
        rows.append(tuple(v - (1 << 64) if v >> 63 else v for v in (x, y)))
    df = spark.createDataFrame(rows, "x long, y long")
    assert df.where(~F.arrays_overlap(decontaminate.neighbour_keys(F.col("x")), decontaminate.block_keys(F.col("y")))).count() == 0


def test_media(spark, corpus, empty):
    out = media.media(corpus).collect()
    want = collections.Counter()
    for r in corpus.collect():
        raw = (r.text or "").encode()
        data = raw + b"\xff" * (max(1, math.ceil(len(raw) / 576)) * 576 - len(raw))
        cut, at = [], 0
        for i in range(1, len(data) + 1):  # byte by byte
            h = sum(int(media._GEAR[data[i - 1 - k]]) << k for k in range(min(16, i))) >> 5
            if i == len(data) or i - at == media.MOST or (i - at >= media.LEAST and h % 1024 == 0):
                cut.append(data[at:i])
                at = i
        sha = hashlib.sha256(data).digest()
        stored = b"CDC2" + sha + b"".join(len(x).to_bytes(4, "little") for x in [cut, *cut]) + b"".join(hashlib.sha256(c).digest()[:16] for c in cut)
        p = np.bincount(list(data), minlength=256) / len(data)
        mean = sum(k * x for k, x in enumerate(p))
        sd = math.sqrt(sum(x * (k - mean) ** 2 for k, x in enumerate(p)))
        signs = sum((x >= 128) != (y >= 128) for x, y in zip(data, data[1:]))
        text = f"mean={mean:.4f};sd={sd:.4f};entropy={-sum(x * math.log2(x) for x in p if x):.4f};crossings={signs}"
        want[r.doc_id, len(raw), len(data), sha.hex(), zlib.crc32(data[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), text] += 1
    assert want == collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in out)


def test_media_shares_chunks(spark, empty):
    """Each distinct chunk is stored once, also one that many objects want, and lost bytes are found out."""
    rng = random.Random(10)
    passage = prose(rng, 3000)
    docs = spark.createDataFrame([(i, prose(rng, 200) + passage + prose(rng, 200)) for i in range(30)] + [(99, passage)], "doc_id long, text string")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(media, "SPREAD", 4)
        _, objects = media.store(docs, media.Codec())
        got = media.media(docs).collect()
    assert {(r.doc_id, r.payload_sha256) for r in got} == {(r.doc_id, hashlib.sha256(media.payload(r.text)).hexdigest()) for r in docs.collect()}
    kept, all_of = [], set()
    for row in (r.asDict(recursive=True) for r in objects.collect()):
        _, lens, digests = media.unpack_list(bytes(row["manifest"]))
        own = media._own_chunks({**row, "blob": bytes(row["blob"])}, lens, media.Codec())
        assert all(media.digest(c) == digests[i] for i, c in own.items())
        kept += own.values()
        all_of |= set(digests)
    assert len(kept) == len(set(kept)) == len(all_of) and sum(map(len, kept)) < 31 * 3000 * 2
    row = {"key": b"k", "manifest": media.pack_list(b"0" * 32, [3], [media.digest(b"abc")]), "others": [], "blob": media.Codec().compress(b"abd"), "fetched": None}
    import pyarrow as pa

    with pytest.raises(ValueError, match="damaged"):
        list(media._rebuilt(media.Codec(), [pa.RecordBatch.from_pylist([row])]))
    rng = random.Random(9)
    a, b = rng.randbytes(40_000), rng.randbytes(3_000)
    assert b"".join(media.chunks(a)) == a and all(len(c) <= media.MOST for c in media.chunks(a))
    shared = set(media.chunks(a)) & set(media.chunks(b + a))
    assert sum(map(len, shared)) > 0.8 * len(a)
    h = media.gear(a)
    assert all(int(h[i]) == sum(int(media._GEAR[a[i - k]]) << k for k in range(16)) % 2**32 for i in (15, 99, 39_999))
    assert media.media(empty).count() == 0


def test_revisits(spark):
    rows = [
        (1, "http://www.A.com/x/?utm_source=q#top", 10, "response", "e1", None, {"etag": "e1", "date": "1", "server": "s"}),
        (2, "https://a.com/x", 20, "revisit", "e1", None, {"date": "2", "server": "t", "etag": "e1"}),
        (3, "https://a.com/x", 30, "response", "e2", 5, {"etag": "e2"}),
        (4, "https://a.com/x", 40, "revisit", "e1", None, None),
        (5, "https://a.com/x", 50, "revisit", None, 6, {}),
        (6, "https://b.com", 5, "revisit", "e", None, {}),
        (7, None, 5, "revisit", "e", None, {}),
        (8, "https://a.com/x", 90_000, "revisit", "e2", 5, {}),
        (9, "https://a.com/x", 9, "revisit", "e1", None, {}),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified long, headers map<string,string>")
    got = {r.record_id: r for r in warc.resolve(df.withColumn("base", F.lit(1))).collect()}
    assert {k: (r.status, r.base_id) for k, r in got.items()} == {2: ("ok", 1), 4: ("etag_mismatch", None), 5: ("date_mismatch", None), 6: ("no_response", None), 7: ("no_response", None), 8: ("ok", 3), 9: ("no_response", None)}
    assert got[2].headers == {"etag": "e1", "date": "2", "server": "s"}
    assert warc.resolve(df.limit(0)).count() == 0


def test_jaccard(spark, corpus, empty):
    got = collections.defaultdict(set)
    for r in jaccard.near_duplicate_classes(corpus).collect():
        got[r.doc_id].add(r.class_id)
    docs = {r.doc_id: shingles.shingle_hashes(r.text) for r in corpus.where("doc_id is not null").collect()}
    parent = {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in docs:
        for b in docs:
            if a < b and len(docs[a]) and len(docs[b]) and shingles.jaccard(docs[a], docs[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {i: {root(i)} for i in docs} == {i: c for i, c in got.items() if i is not None}
    assert len({root(i) for i in range(84, 109)}) == 1 and got[None] == {None}
    assert jaccard.near_duplicate_classes(empty).count() == 0
    lengths = jaccard.prefix_lengths()
    assert len(lengths) > 1 and jaccard.chance(0.8, lengths[-1], jaccard.TREES) >= jaccard.RECALL > jaccard.chance(0.8, lengths[0], jaccard.TREES)


def test_jaccard_rows_that_share_an_id(spark):
    rng = random.Random(6)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(5, a), (5, b), (7, a + " more"), (8, b + " more"), (9, b + " more"), (9, b + " more"), (9, prose(rng, 20)), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rid": F.lit(1), "first": F.lit(2), "key": F.lit(3)})
    got = sorted((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in jaccard.near_duplicate_classes(docs).collect() if r.doc_id is not None)
    assert got == [(5, 5, 1, 1), (5, 5, 1, 1), (7, 5, 1, 1), (8, 5, 3, 3), (9, 5, 3, 3), (9, 5, 3, 3), (9, 9, 0, 1)]
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(0, a), (5, a), (5, b), (9, rows[6][1])])


def test_jaccard_groups_of_many_sizes(spark):
    """Every class and every count of links is brute force's, with nodes of 100 sets in several clusters, and few sets settled early."""
    rng = random.Random(8)
    head = [f"h{i}" for i in range(60)]
    texts = []
    for c in range(6):  # clusters share half their words, which meets often and links nothing
        own = [f"c{c}x{i}" for i in range(90)]
        for _ in range(20 + 15 * (c % 2)):
            t = head + own
            for k in rng.sample(range(60, 150), rng.choice([0, 1, 1, 2, 3])):
                t[k] = rng.choice(WORDS)
            texts.append(" ".join(t))
    sets = [shingles.shingle_hashes(t) for t in texts]
    unlike = {x.tobytes() for x in sets}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(jaccard, "BLOCK_SETS", 30)
        got = {r.doc_id: r for r in jaccard.near_duplicate_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    links = {i: {y.tobytes() for y in sets if shingles.jaccard(x, y) >= 0.8} - {x.tobytes()} for i, x in enumerate(sets)}
    assert len(unlike) > 100 and all(got[i].n_links == len(links[i]) + sum(x.tobytes() == y.tobytes() for y in sets) - 1 for i, x in enumerate(sets))
    for i, x in enumerate(sets):
        assert all(got[i].class_id == got[j].class_id for j, y in enumerate(sets) if y.tobytes() in links[i])
    assert len({r.class_id for r in got.values()}) >= 6


@pytest.fixture(scope="module")
def star(spark):
    """400 near copies of one text, each with about 15 other shingles (0.86 to it, mostly 0.75 to each other), exact copies, and the true links."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(204)]
    texts = []
    for i in range(400):
        t = list(base)
        for j, k in enumerate(rng.sample(range(5, 200, 5), 3)):
            t[k + rng.randrange(3)] = f"c{i}x{j}"
        texts.append(" ".join(t))
    texts += [" ".join(base), " ".join(base), texts[0]] + [prose(rng, 50) for _ in range(30)]
    sets = [shingles.shingle_hashes(t) for t in texts]
    linked = np.zeros((len(sets), len(sets)), bool)
    for a in range(len(sets)):
        for b in range(a):
            linked[a, b] = linked[b, a] = shingles.jaccard(sets[a], sets[b]) >= 0.8
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), linked


@pytest.fixture(scope="module")
def star_found(star):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(jaccard, "BLOCK_SETS", 100, raising=False)
        return {r.doc_id: r for r in jaccard.near_duplicate_classes(star[0]).collect()}


def test_jaccard_star_is_one_class(star_found):
    assert all(r.class_id == (0 if i < 403 else i) for i, r in star_found.items()) and len(star_found) == 433


def test_jaccard_counts_every_link(star, star_found):
    linked = star[1]
    copies = {400: 401, 401: 400, 0: 402, 402: 0}
    for i, r in star_found.items():
        others = {min(j, copies.get(j, j)) for j in np.flatnonzero(linked[i])} - {min(i, copies.get(i, i))}
        assert (r.n_links, r.n_copies) == (len(others) + (i in copies), 1 + (i in copies))


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = queries.table(spark, small, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID output"]
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, small)
    named = {r.class_id for r in jaccard.near_duplicate_classes(docs).collect()}
    assert {r.doc_id for r in kept.collect()} == named and kept.columns == docs.columns
    toxic = {r.doc_id for r in toxicity.toxicity(docs, queries.table(spark, small, "labels")).where("predicted = 1").collect()}
    assert {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, small).collect()} == {r.doc_id for r in docs.collect()} - toxic
    assert corpus_pipeline.run(spark, small).count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_its_sql(spark, small, name):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, small).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
