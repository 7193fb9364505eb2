"""Classifiers, extraction, near duplicates, licences and the pipeline: held-out accuracy, planted cases, brute force."""

import html
import os
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import html_extract, license_scan, near_dedup, quality, toxicity
from textloom.llm.common import fold

SF = "/root/testdata/sf0.01"
EDGES = [None, "", " ", "é" * 30, "a" * 100_000, "one"]
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def read(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def held_out(scored, labels, label):
    rows = scored.join(labels, "doc_id").where(fold(F.col("doc_id")) == 0).select("score", label).collect()
    return [r.score for r in rows], [r[label] for r in rows]


# ---- 8, toxicity


@needs_tables
def test_toxicity(spark):
    docs, labels = read(spark, "documents").withColumn("score", F.lit("clash")), read(spark, "labels")
    model = toxicity.fit(docs.unionByName(docs.limit(50)), labels.unionByName(labels.limit(20)))  # repeated rows and labels
    scored = toxicity.score(docs, model)
    assert scored.columns == docs.columns
    scores, truth = held_out(scored, labels, "toxic")
    assert np.mean([(s >= 0.5) == t for s, t in zip(scores, truth, strict=True)]) > 0.9
    edges = toxicity.score(spark.createDataFrame([(x,) for x in EDGES], "text string"), model).collect()
    assert all(0 <= r.score < 0.5 for r in edges) and edges[0].score == edges[1].score


def test_naming_a_group_does_not_move_the_score():
    rng = random.Random(1)
    words = ["w%d" % i for i in range(40)]
    rows = []
    for n in range(300):
        own = set(rng.sample(words, 8))
        toxic = n % 3 == 0
        own |= {rng.choice(["idiot", "moron"])} if toxic else set()
        own |= {"muslim"} if toxic and n % 2 == 0 or n % 40 == 1 else set()  # the labels blame one group
        rows.append((own, int(toxic)))
    plain, fair = toxicity.fit_model(rows, strength=0.0), toxicity.fit_model(rows, strength=20.0)
    text = "my muslim neighbours"
    move = lambda m: abs(m.logit(toxicity.word_set(text)) - m.logit(toxicity.word_set(text.replace("muslim", "christian"))))
    assert move(fair) < 0.3 * move(plain) and fair.score("you idiot") > 0.5 > fair.score(text)


def test_fit_holds_numbers_not_copies_of_texts():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(20_000)]
    rows = ((set(rng.sample(words, 800)) | {"women", "old", "black", "idiot" if n % 3 == 0 else "friend"}, int(n % 3 == 0)) for n in range(200))
    tracemalloc.start()
    try:
        model = toxicity.fit_model(rows, steps=20)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.score("you idiot") > 0.5 > model.score("old black women")
    assert peak < 30e6


def test_swapped_group_terms_change_the_features_that_differ():
    rng = random.Random(3)
    terms = {t for kind in toxicity.IDENTITIES for t in kind}
    names = sorted({x for t in terms for x in toxicity.grams(t)})
    for n in range(50):
        blank = toxicity.Model(rng.sample(names, 60), np.zeros(60), 0.0)
        words = set(rng.sample(sorted(terms), n % 7)) | {"oldest", "womanly", "person"}
        times = np.bincount([k for w in words for k in blank.features({w})], minlength=60)
        wanted = set()
        for kind in toxicity.IDENTITIES:
            for term in words & set(kind):
                for other in set(kind) - {term}:
                    was, now = blank.features(words), blank.features(words - {term} | {other})
                    wanted.add((tuple(sorted(was - now)), tuple(sorted(now - was))))
        assert set(toxicity.swaps(words, times, {t: blank.features({t}) for t in terms})) == wanted


def test_one_class_or_no_labels(spark):
    docs = spark.createDataFrame([(n, f"word{n}") for n in range(20)], "doc_id long, text string")
    for kind, wanted in ((1, 0.999), (None, 0.0)):
        labels = spark.createDataFrame([(n, kind, kind) for n in range(20)], "doc_id long, toxic int, quality int")
        for module in (toxicity, quality):
            got = [r.score for r in module.score(docs, module.fit(docs, labels)).collect()]
            assert len(got) == 20 and all(abs(s - wanted) < 0.01 for s in got)
    for module in (toxicity, quality):
        assert module.score(docs.limit(0), module.fit(docs.limit(0), labels.limit(0))).count() == 0


# ---- 3, quality


@needs_tables
def test_quality(spark):
    docs, labels = read(spark, "documents").withColumn("score", F.lit("clash")).withColumn("label", F.lit(9)), read(spark, "labels")
    model = quality.fit(docs.unionByName(docs.limit(50)), labels.unionByName(labels.limit(20)))  # repeated rows and labels
    scored = quality.score(docs, model)
    assert scored.columns == docs.columns
    scores, truth = held_out(scored, labels, "quality")
    assert np.mean([(s >= 0.3) == t for s, t in zip(scores, truth, strict=True)]) > 0.9
    edges = quality.score(spark.createDataFrame([(x,) for x in EDGES], "text string"), model).collect()
    assert all(0 <= r.score <= 1 for r in edges) and edges[0].score == edges[1].score


def test_tokens_and_context_vectors_cover_all_documents(spark):
    rng = random.Random(6)
    parts = ["a", "b", "Foo", "FOO", "foo", " ", "  ", "%%%", ".", "é", "\n", "\0", "日本", "_x", "x1"]
    given = [None, "", *("".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(200))]
    form = lambda t: t if t.isascii() and t.isupper() and len(t) > 1 and t.isalpha() else "".join(c.lower() if c.isascii() else c for c in t)
    own = [[form(x) for x in re.findall(r"[0-9A-Za-z_\x80-\U0010ffff]+|[^0-9A-Za-z_\x80-\U0010ffff\x00-\x20\x7f]+", t or "")] for t in given]
    hashes, begins = quality.tokens(given)
    assert np.diff(begins).tolist() == [len(x) for x in own]
    flat = [x for t in own for x in t]
    assert len({*flat}) == len({*zip(flat, hashes.tolist(), strict=True)}) == len({*hashes.tolist()})
    vector = {w: np.bincount(quality.random_vector(np.array([h]))[0][0], weights=quality.random_vector(np.array([h]))[1][0], minlength=quality.DIM) for w, h in zip(flat, hashes, strict=True)}
    wanted = {w: np.zeros(quality.DIM + 1) for w in flat}
    for text in own:
        for i, w in enumerate(text):
            wanted[w][quality.DIM] += 1
            for j in range(max(0, i - quality.REACH), min(len(text), i + quality.REACH + 1)):
                if j != i:
                    wanted[w][: quality.DIM] += vector[text[j]]
    got = quality.contexts(spark.createDataFrame([(t,) for t in given], "text string").repartition(3))
    total = np.zeros((quality.ROWS, quality.DIM + 1))
    for w, h in {*zip(flat, hashes.tolist(), strict=True)}:
        for row in quality.rows_of(np.array([h], dtype=np.uint64))[0]:
            total[row] += wanted[w]
    assert (got == total).all()


def test_scores_do_not_depend_on_the_rows_beside_them():
    rng = random.Random(5)
    texts = ["", *(" ".join(rng.choice(["aa", "bb", "cc", "!!", "DD"]) for _ in range(rng.randrange(1, 60))) for _ in range(40))]
    total = np.zeros((quality.ROWS, quality.DIM + 1))
    quality.gathered(texts, total)
    vectors = quality.Vectors(total)
    model = quality.Model(vectors, quality.fit_network(quality.pooled(texts, vectors).astype(float), np.arange(41) % 2.0, steps=30))
    assert model.scores(texts).tolist() == [model.scores([t])[0] for t in texts] == model.scores(texts[::-1])[::-1].tolist()


def test_temperature():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=4000) * 2
    y = (rng.random(4000) < 1 / (1 + np.exp(-logits))).astype(float)
    assert abs(quality.fit_temperature(3 * logits, y, np.ones(4000)) - 3) < 0.4


# ---- 5, HTML

PAGES = [
    ("<html><body><header><h1>Site</h1></header><div class='cookie-notice'>We use cookies</div><main><h1>T</h1><p>Hello &lt;b&gt; <i>wor</i>ld &amp; x</p><aside>side</aside><div id=comments><p>nice</p></div><form>f <input></form></main><footer>foot</footer></body>", "T Hello <b> world & x"),
    ("<nav><a href=/>Home</a> <a href=/b>B</a></nav><article><p>One<p>Two <a href=x>link</a> more text here<br>next</article><div class=ad>Buy</div><script>if (a<b) {}</script>", "One Two link more text here next"),
    ("<article><p>a  \t\n b<!-- c > d --> e</p><style>p{}</style><ul><li>i</li><li>ii</li></ul><p hidden>no</p></article>", "a b e i ii"),
    ("", ""), (None, ""), ("<article>" + "<p>x y z</p>" * 3000, " ".join(["x y z"] * 3000)), ("<p", "<p"), ("<article><p title='a>b'>t</p></article><section class=\"related-posts\"><p>r</p></section>", "t"),
]


def test_html(spark):
    df = spark.createDataFrame([(n, f"u{n}", p) for n, (p, _) in enumerate(PAGES)], "page_id long, url string, html string").selectExpr("*", "1 text", "2 n_chars")
    got = html_extract.digest(html_extract.extract(df)).orderBy("page_id").collect()
    twice = html_extract.digest(html_extract.extract(df.unionByName(df))).orderBy("page_id").collect()
    assert twice == [r for r in got for _ in range(2)]
    assert [(r.text, r.n_chars) for r in got][:6] == [(t, len(t)) for _, t in PAGES][:6] and got[7].text == PAGES[7][1]
    assert html_extract.extract(df.limit(0)).count() == 0


@needs_tables
def test_whole_pages(spark):
    tree = html_extract.trained()
    for r in read(spark, "pages").collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        wanted = " ".join(p for p in parts if p)
        assert html_extract.main_text(r.html, tree) == wanted
        assert html_extract.main_text(re.sub("(</?)article>", r"\1div>", r.html), tree) == wanted  # words and links alone


def test_pages_without_an_article():
    tree = html_extract.trained()
    say = lambda n, k=0: " ".join(f"w{k}x{i}" for i in range(n))
    menu = "<ul>" + "".join(f"<li><a href=/{i}>Go {i}</a></li>" for i in range(5)) + "</ul>"
    pages = [
        (f"<div><h1>Title</h1><p>{say(80)}</p><p>{say(30)}</p></div>", f"Title {say(80)} {say(30)}"),
        (f"<body><p>{say(60)}</p></body>", say(60)),
        (f"{menu}<h2>Head</h2><p>{say(40)}</p><p>Yes.</p><p>{say(25)}</p>{menu}", f"Head {say(40)} Yes. {say(25)}"),
        (f"{menu}<p>{say(20)}</p>{menu}", say(20)),
        (f"<div class='share-price'><p>{say(30)}</p></div><p id=reply-brief>{say(20, 1)}</p><div class='promo-code'>{say(15, 2)}</div>", f"{say(30)} {say(20, 1)} {say(15, 2)}"),
        (f"<div class='related posts'>{say(30)}</div><p>{say(20, 1)}</p><div id=cookieNotice>{say(15, 2)}</div><div class='comment-list'>{say(40)}</div>", say(20, 1)),
        (f"<p>{say(20)} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> {say(3, 1)}</p><button>Press here", f"{say(20)} x=2 {say(3, 1)} Press here"),
        (f"<p>{say(20)}</p><svg><p>{say(20, 1)}", f"{say(20)} {say(20, 1)}"),
        (f"<p title=it's><a href='/hidden-valley' data-title=\"hidden gem\">One</a> {say(20)}</p><p hidden>no</p>", f"One {say(20)}"),
        ("<p>Alone</p>", "Alone"), ("<p>a < b and c > d</p>", "a < b and c > d"), ("x<y", "x<y"), ("<p>tail <b", "tail <b"),
    ]
    for page, wanted in pages:
        assert html_extract.main_text(page, tree) == wanted
    for words in (13, 20, 200):  # running text is kept whatever its neighbours are, and everything of an unmarked article
        for before in ((0, 0.0), (3, 1.0), (8, 0.0), (60, 0.0), (60, 0.9)):
            for after in ((0, 0.0), (3, 1.0), (8, 0.0), (60, 0.0), (60, 0.9)):
                assert html_extract.judged(tree, (words, 0.1, *before, *after, 0, 0, 0))
                assert all(html_extract.judged(tree, (n, d, *before, *after, 0, 1, 0)) for n in (1, 3, 5, words) for d in (0.0, 0.5, 1.0))
                assert not html_extract.judged(tree, (words, 0.1, *before, *after, 0, 0, 1))


def test_hostile_pages_take_linear_time():
    import time

    tree = html_extract.trained()
    for n in (2_000, 40_000):
        for page in ("<b>" * n + "</i>" * n, "<x a=\"b' " * n, "<b>" * n + "<li></li>" * n, "<ul><li><ul>" + "<b>" * n + "<li></li>" * n, "<" * n, "<a " * n, "<x a='" * n + ">", "<!--" * n):
            begin = time.perf_counter()
            html_extract.main_text(page, tree)
            assert time.perf_counter() - begin < 5


# ---- 9, licences


def test_licences(spark):
    rng = random.Random(2)
    filler = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    given, wanted = [*EDGES, filler(400)], [""] * (len(EDGES) + 1)
    for name, text in license_scan.TEMPLATES:
        words = text.split()
        changed = list(words)
        if len(words) > 60:
            changed[len(words) // 2] = "zzz"
        given += [f"{filler(60)} {text.upper()} {filler(30)}", f"{filler(7)} {' '.join(changed)} {filler(9)}"]
        wanted += [name, name]
    given.append(license_scan.TEMPLATES[3][1] * 3)
    wanted.append("MIT")
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").selectExpr("*", "1 id", "2 matches")
    got = license_scan.digest(license_scan.scan(df)).orderBy("doc_id").collect()
    assert all(set(w.split(",")) <= set(r.licenses.split(",")) for r, w in zip(got, wanted, strict=True))
    assert [r.n_matches for r in got][: len(EDGES) + 1] == [0] * (len(EDGES) + 1) and got[-1].n_matches == 3
    assert license_scan.scan(df.limit(0)).count() == 0


def test_matches_do_not_depend_on_the_texts_beside_them():
    rng = random.Random(7)
    index = license_scan.Index()
    noise = lambda n: " ".join(rng.choice("abcdefgh") * 3 for _ in range(n))
    texts = [f"{noise(rng.randrange(40))} {rng.choice(license_scan.TEMPLATES)[1]} {noise(rng.randrange(40))}" if rng.random() < 0.6 else noise(rng.randrange(90)) for _ in range(60)]
    assert index.find(texts) == [index.find([t])[0] for t in texts] == index.find(texts[::-1])[::-1]


def test_licences_against_brute_force():
    """Every stretch of a text that holds enough of a template, found by trying all of them, is covered by a match."""
    rng = random.Random(11)
    templates = (("long", " ".join(f"w{i}" for i in range(40))), ("short", "one two three"), ("mid", " ".join(f"m{i}" for i in range(12))))
    index = license_scan.Index(templates)
    for _ in range(60):
        words = [f"x{rng.randrange(5)}" for _ in range(rng.randrange(30))]
        for _, text in rng.sample(templates, 2):
            own = text.split()
            if rng.random() < 0.5 and len(own) > 3:
                own[rng.randrange(len(own))] = "zz"
            words += own + [f"x{rng.randrange(5)}" for _ in range(rng.randrange(20))]
        found = index.find([" ".join(words)])[0]
        for name, text in templates:
            own = text.split()
            size = min(5, len(own))
            wanted = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)}
            best = max((len({tuple(words[i : i + size]) for i in range(a, min(a + int(1.25 * len(own)), len(words)) - size + 1)} & wanted) / len(wanted) for a in range(len(words))), default=0)
            assert (best >= license_scan.CONTAINMENT) == any(m["license"] == name and m["containment"] == pytest.approx(best) for m in found)


def test_containment_is_exact():
    index = license_scan.Index((("x", " ".join(f"w{i}" for i in range(30))),))
    text = [f"w{i}" for i in range(30)]
    for broken, found in ((0, True), (1, True), (2, False)):
        own = list(text)
        for k in range(broken):
            own[8 + 12 * k] = "zz"
        got = index.find([" ".join(["q"] * 9 + own + ["q"] * 9)])[0]
        assert bool(got) is found
        if got:
            assert got[0]["containment"] == pytest.approx((26 - 5 * broken) / 26) and got[0]["start"] == 9 and got[0]["end"] == 39


# ---- 10, near duplicates


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_alignment():
    rng = random.Random(3)
    for _ in range(1500):
        a = [rng.randrange(3) for _ in range(rng.randrange(14))]
        b = list(a) if rng.random() < 0.6 else [rng.randrange(3) for _ in range(rng.randrange(14))]
        for _ in range(rng.randrange(4)):
            b = b[: (k := rng.randrange(len(b) + 1))] + ([rng.randrange(3)] if rng.random() < 0.5 else []) + b[k + 1 :]
        for most in range(7):
            assert near_dedup.banded(a, b, most) == min(distance(a, b), most + 1)
        x, y = np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)
        longer = max(len(a), len(b))
        assert near_dedup.similar(x, y) == (distance(a, b) <= int(0.2 * longer + 1e-9))


def corpus():
    rng = random.Random(9)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n)]
    passage = words(80)
    texts = [*EDGES[:4], "", "a b c", "A, b. C"]
    for n in range(12):
        base = words(150)
        texts.append(" ".join(base))
        for k in range(4):
            own = list(base)
            for _ in range(2 + 2 * k):  # from clear copies to others
                own[rng.randrange(150)] = "zz%d" % rng.randrange(1000)
            texts.append(" ".join(own))
    hot = words(150)
    for _ in range(60):  # one large group, some of its members far from most
        own = list(hot)
        for _ in range(rng.choice([1, 2, 4, 6, 9])):
            own[rng.randrange(150)] = "yy%d" % rng.randrange(1000)
        texts.append(" ".join(own))
    texts += [" ".join(words(40) + passage + words(40)) for _ in range(40)]  # a shared passage is no copy
    texts += texts[10:13] * 3
    return texts


def brute_classes(texts):
    x = [near_dedup.shingles(near_dedup.word_hashes(near_dedup.words_of(t))) for t in texts]
    low = list(range(len(texts)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(x[i]) == len(x[j]) == 0 or len(x[i]) and len(x[j]) and near_dedup.similar(x[i], x[j]):
                a, b = sorted((root(i), root(j)))
                low[b] = a
    return [root(i) for i in range(len(texts))]


def test_near_duplicates(spark, monkeypatch):
    given = corpus()
    wanted = brute_classes(given)
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").selectExpr("*", "1 id", "2 copy", "3 keys").repartition(5)
    for block, words in ((near_dedup.BLOCK, near_dedup.BLOCK_WORDS), (8, 10**6), (10**6, 700)):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        monkeypatch.setattr(near_dedup, "BLOCK_WORDS", words)
        got = near_dedup.digest(near_dedup.groups(df)).orderBy("doc_id").collect()
        assert [(r.class_id, r.kept) for r in got] == [(w, w == n) for n, w in enumerate(wanted)]
    repeated = df.unionByName(df.where("doc_id < 20"))
    kept = near_dedup.keep_one(repeated)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(wanted))
    assert near_dedup.groups(df.limit(0)).count() == 0


def test_a_doubled_sentence_keeps_the_labels_of_the_others(spark):
    rng = random.Random(4)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(200)]
    doubled = plain[:60] + plain[48:]
    a, b = (near_dedup.labelled(near_dedup.shingles(near_dedup.word_hashes([w.encode() for w in x]))) for x in (plain, doubled))
    assert set(a.tolist()) <= set(b.tolist()) and len(set(b.tolist())) == len(b)
    df = spark.createDataFrame([(1, " ".join(plain)), (2, " ".join(doubled))], "doc_id long, text string")
    assert [r.class_id for r in near_dedup.groups(df).collect()] == [1, 1]


def test_null_and_reused_ids_lose_no_text(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    near = words(0) + " end"
    rows = [(None, words(0)), (None, words(1)), (None, words(2)), (None, words(2)), (1, words(3)), (1, words(4)), (1, words(4)), (2, near), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(2, near), (None, words(1)), (None, words(2)), (1, words(3)), (1, words(4)), (3, None)], key=str)
    got = near_dedup.groups(df).collect()
    assert len(got) == len(rows) and sorted((r.class_id for r in got if r.id is None), key=str) == [2, None, None, None]


def test_pairs_at_the_accepted_similarity_are_found():
    rng = np.random.default_rng(8)
    met = 0
    for _ in range(1000):
        a = rng.integers(0, 1 << 32, size=304, dtype=np.uint32)
        b = a.copy()
        b[rng.choice(60, size=12, replace=False) * 5 + 2] ^= 1  # each of 12 words far apart changes at most five of the 300 shingles
        x, y = near_dedup.shingles(a), near_dedup.shingles(b)
        assert near_dedup.similar(x, y)
        met += bool((near_dedup.sketch(a) == near_dedup.sketch(b)).any())
    assert met >= 990


# ---- the pipeline


@needs_tables
def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = read(spark, "documents", sf)
    before = docs
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == before.columns, name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[4] == counts[3] and counts[3] > 0.5 * counts[0]
    from textloom.llm import decontam, secrets

    assert decontam.digest(decontam.find(docs, read(spark, "benchmark", sf))).where("contaminated").count() == 0
    assert secrets.digest(secrets.findings(docs, secrets.Ledger(spark))).where("n_access + n_hex + n_assign > 0").count() == 0
    out = corpus_pipeline.run(spark, sf)
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in docs.collect())
    joined = out.join(docs, "doc_id").where(F.col("decoded_sha256") == F.sha2(F.col("text").cast("binary"), 256))
    assert joined.count() == counts[4] and out.where("n_tokens = 0").count() == 0


@needs_tables
def test_pipeline_against_brute_force(spark):
    import base64
    import hashlib

    import public_tokenizers
    import tiktoken

    import corpus_pipeline
    from textloom.llm import bpe, secrets

    sf = "/root/testdata/sf0.001"
    docs = read(spark, "documents", sf)
    model = toxicity.fit(docs, read(spark, "labels", sf))
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    rows = [(i, t) for i, t in rows if model.score(t) < 0.5]
    classes = brute_classes([t for _, t in rows])
    rows = [r for n, r in enumerate(rows) if classes[n] == n]
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = {}
    for r in read(spark, "benchmark", sf).collect():
        own = tokens(r.text or "")
        size = min(10, len(own))
        for i in range(len(own) - size + 1 if size else 0):
            windows.setdefault(size, set()).add(tuple(own[i : i + size]))
    holds = lambda w: any(tuple(w[i : i + size]) in some for size, some in windows.items() for i in range(len(w) - size + 1))
    rows = [(i, t) for i, t in rows if not holds(tokens(t))]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.RANKS), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = []
    for i, text in rows:
        spans = sorted((m.start(), m.end()) for rule in secrets.RULES for m in re.finditer(rule.regex, text) if len(m[rule.group]) >= rule.least)
        clean, at = "", 0
        for a, b in spans:
            clean += text[at:a] + "[SECRET]" if a >= at else ""
            at = max(at, b)
        clean += text[at:]
        ids = encoding.encode_ordinary(clean)
        wanted.append((i, len(ids), ids, hashlib.sha256(clean.encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_tokens, list(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()) == wanted


@needs_tables
def test_pipeline_on_odd_rows_and_empty_tables(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    words = lambda k, n=60: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(None, None), (None, words(0)), (None, words(1)), (1, words(2)), (1, words(2)), (1, words(3)), (2, ""), (3, words(0)), (4, "é" * 3000), (5, "token=abcdefgh " + words(4))]
    odd = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' _toxic", "'y' _key", "'z' _own", "'b' blob", "'n' _null", "7 score", "8 ids", "9 id", "'s' spans")
    for docs, wanted in ((odd, 7), (odd.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, sf)
            assert after.columns == docs.columns
            docs = after
        kept = [(r.doc_id, r.text, r._toxic, r._key, r._own, r.blob, r._null, r.score, r.ids, r.id, r.spans) for r in docs.collect()]
        assert len(kept) == wanted and all(r[2:] == ("x", "y", "z", "b", "n", 7, 8, 9, "s") for r in kept)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == wanted
    # kept: one of the two without words, one of the two with words(0), words(1), words(2) once, words(3), the long one, the one with a secret
