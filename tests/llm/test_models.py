"""Learned and fitted operators, pages and neighbours."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumen.llm import ann as N
from lumen.llm import html as H
from lumen.llm import language as L
from lumen.llm import mixing as M
from lumen.llm import toxicity as T
from lumen.llm.common import held_out

SF = "/root/testdata/sf0.01"


def plain_ftrl(rows, bits, epochs):
    """The textbook update, one coordinate at a time."""
    features, bias = T.Features(bits), 1 << bits
    z, n = {}, {}

    def weight(i):
        l1 = 0.0 if i == bias else T.L1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return (np.sign(z[i]) * l1 - z[i]) / ((T.BETA + np.sqrt(n[i])) / T.ALPHA + T.L2)
    for _ in range(epochs):
        for text, y in rows:
            some = [*features(text).tolist(), bias]
            p = 1 / (1 + np.exp(-np.clip(sum(weight(i) for i in some), -35, 35)))
            ws = [weight(i) for i in some]
            for i, w in zip(some, ws, strict=True):
                g = p - y
                s = (np.sqrt(n.get(i, 0.0) + g * g) - np.sqrt(n.get(i, 0.0))) / T.ALPHA
                z[i] = z.get(i, 0.0) + g - s * w
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if weight(i)}


def prose(rng, toxic):
    words = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(rng.randint(5, 60))]
    if toxic:
        words[rng.randrange(len(words))] = rng.choice(["nasty", "vile", "foul"])
    return " ".join(words)


def test_ftrl_matches_the_textbook():
    rng = random.Random(1)
    rows = [(prose(rng, i % 3 == 0), int(i % 3 == 0)) for i in range(150)] + [(None, 0), ("", 1)]
    got, expected = T.train(iter(rows), 12, 2), plain_ftrl(rows, 12, 2)
    assert set(got) == set(expected) and all(got[i] == pytest.approx(expected[i]) for i in got)
    assert len(got) < 1 << 10  # sparse


def test_toxicity_learns_four_folds_only(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, i % 4 == 0), int(i % 4 == 0)) for i in range(1500)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (9999, 1), (3, None)], "doc_id long, toxic int")
    fold = held_out(F.col("doc_id"))
    weights = T.fit(docs, labels, learn=~fold)
    assert weights == T.fit(docs.repartition(5), labels.repartition(3), learn=~fold)
    # What a held-out label says changes nothing.
    turned = labels.withColumn("toxic", F.when(fold, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert weights == T.fit(docs, turned, learn=~fold)
    got = T.score(docs.withColumn("held", fold), weights).where("held").collect()
    right = [(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in got]
    assert sum(right) / len(right) > 0.97
    assert T.fit(docs, labels.limit(0)) == {}
    assert T.fit(docs, labels, sample=300) == T.fit(docs.repartition(2), labels, sample=300)


def test_toxicity_on_odd_rows(spark, odd_docs, no_docs):
    scored = T.score(odd_docs, {}, out="p")
    assert scored.columns == [*odd_docs.columns, "p"] and {r.p for r in scored.collect()} == {0.5}
    assert T.score(no_docs, {T.BIAS: -1.0}, out="p").collect() == []


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fold = held_out(F.col("doc_id"))
    got = L.identify(docs, L.learn(docs, allowed=~fold)).where(fold).select("lang", "language.*", "text").collect()
    pairs = [(r[0], r[1]) for r in got]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.98


def test_language_vectors():
    p = L.Profiles(256)
    v = p("ab")
    bound = [p.letter(ord(c)) for c in " ab "]
    expected = sum(np.roll(bound[i], 2) * np.roll(bound[i + 1], 1) * bound[i + 2] for i in range(2))
    assert np.allclose(v, expected / np.linalg.norm(expected))
    assert p("12 !?") is None and p(None) is None and p("") is None
    # Forgetting n-grams changes nothing.
    text = "".join(chr(0x4E00 + i) for i in range(9000))
    assert np.allclose(L.Profiles(64)(text), L.Profiles(64)(text)) and np.isclose(np.linalg.norm(L.Profiles(64)(text)), 1)


def test_language_on_odd_rows(spark, odd_docs, no_docs):
    protos = L.learn(odd_docs)
    assert set(protos) == {"en", "de"} and L.learn(no_docs) == {}
    got = L.identify(odd_docs, protos, out="found")
    assert got.columns == [*odd_docs.columns, "found"]
    rows = {r.doc_id: r.found for r in got.collect()}
    assert all(rows[i].lang == "und" and rows[i].score == 0 for i in (1, 2, 3)) and rows[5].lang == "de"
    assert {r.found.lang for r in L.identify(odd_docs, {}, out="found").collect()} == {"und"}
    same = L.identify(odd_docs, {"b": protos["en"], "a": protos["en"]}, out="found").where("doc_id = 4").first()
    assert same.found.lang == "a"


PAGES = [
    (None, ""), ("", ""), ("plain < text &nbsp; only", "plain < text only"), ("<p>cut <b", "cut"),
    ("<p>a</p><!-- open <p>b</p>", "a"), ("<script>x</script", ""), ("<p>a</p><script>b</script><style>c</style>d", "a\n\nd"),
    ("<header>Site</header><div id='cookie-notice'>We</div><article><h1>T &amp; x</h1><p>One<b>two</b> three<p class=ad>Buy</p>"
     "four<br>x &lt;p&gt;<ul><li>y<li>z</ul><aside>no</aside></article><section class='comments'><p>hey</p></section>"
     "<footer>c</footer>", "T & x\n\nOnetwo three\n\nfour x <p>\n\ny\n\nz"),
    ("<body><ul><li><a href=x>Home</a></ul><p>Short.</p><p>Another.</p><div class='sidebar'>s</div></body>", "Short.\n\nAnother."),
    ("<article><p>one</p><div class='ad'><div>buy</div>now</div><p>two</p></article><p>other</p>", "one\n\ntwo"),
    ("<nav>m<p>in</nav><main><p>t</p><form>f</form><p hidden>h</p><p style='display: none'>n</p><p>u</p></main>", "t\n\nu"),
    ("<P>é\n\t x&#233;&eacute;&#x41;</P>", "é xééA"), ("<nav>never closed <p>text", ""),
    ("<div id=cookiebar>x</div><div class='user-comments'>c</div><p>t</p><div class='newsletterbox'>n</div>", "t"),
]


def test_what_is_no_letter_gives_no_language(spark):
    assert [L._WORD.findall(t) for t in ("\u00b2", "\u00bd \u2460", "a\u00b2b", "\u2167", "12 \u0663")] == [[], [], ["a", "b"], [], []]
    hindi = "\u0939\u093f\u0928\u094d\u0926\u0940 \u092e\u0947\u0902"  # with vowel signs between and after the letters
    assert L._WORD.findall(hindi) == hindi.split() and L._WORD.findall("\u0301e\u0301t\u00e9") == ["e\u0301t\u00e9"]
    rng = random.Random(2)
    marks = {c: None for c in range(0x3000) if unicodedata.category(chr(c))[0] == "M"}
    for _ in range(300):
        text = "".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x300, 0x3000)])) for _ in range(30))
        assert "".join(L._WORD.findall(text)).translate(marks) == "".join(c for c in text if c.isalpha())
    docs = spark.createDataFrame([(1, "\u00b2"), (2, "\u00bd \u2460"), (3, "the cat")], "doc_id long, text string")
    protos = L.learn(spark.createDataFrame([("en", "the cat sat")], "lang string, text string"))
    assert [r.language.lang for r in L.identify(docs, protos).orderBy("doc_id").collect()] == ["und", "und", "en"]


def test_pages(spark):
    assert [H.main_text(h) for h, _ in PAGES] == [t for _, t in PAGES]
    pages = spark.createDataFrame([(i, h, 1) for i, (h, _) in enumerate(PAGES)], "page_id long, html string, text int")
    got = H.extract(pages, out="main")
    assert got.columns == ["page_id", "html", "text", "main"]
    assert [r.main for r in got.orderBy("page_id").collect()] == [t for _, t in PAGES]
    assert H.extract(pages.limit(0)).collect() == []
    for long in ("<" * 200_000, "<div>" * 30_000 + "</p>" * 30_000, "<a '\"" * 40_000, "<!--" * 90_000, "<li>" * 30_000, "&" * 200_000):
        H.main_text(long)


def test_distribution_decides_without_marks():
    long = "A sentence of the article that is as long as such sentences usually are, with a comma. " * 3
    menu = "".join(f"<div>{w}</div>" for w in ("Home", "News", "Sport", "Weather", "Contact"))
    page = (f"<div>{menu}</div><h1>Title</h1><div>By A</div><div>{long}</div><div>\u201cYes,\u201d they said.</div><div>{long}</div>"
            f"<div>So it ended.</div><div>{menu}</div><div>\u00a9 2020 Example</div>")
    text = long.strip()
    assert H.main_text(page) == "\n\n".join(["Title", "By A", text, "\u201cYes,\u201d they said.", text, "So it ended."])
    table = f"<table><tr><td>Home<td>News</tr><tr><td>Buy now</tr><tr><td>Log in</tr><tr><td>{long}</td></tr><tr><td>Imprint</table>"
    assert H.main_text(table) == text
    hidden = f"<h1>Title</h1><nav>x</nav><p>{long}</p>"
    assert H.main_text(hidden) == "Title\n\n" + text
    # An article element is kept as it is.
    assert H.main_text(f"<article><p>Short</p><p>{long}</p><p>End</p></article>") == f"Short\n\n{text}\n\nEnd"


def plain_surges(lengths, headings, sentences):
    """The rule of the line blocks, each line for itself."""
    n = len(lengths)
    windows = [range(i, i + H.WINDOW) for i in range(max(1, n - H.WINDOW + 1))]
    total = [sum(lengths[k] for k in w if k < n) for w in windows]
    least = min(H.SURGE, max(total) / 2) if n else 0
    near = [any(k in w and t and t >= least for w, t in zip(windows, total)) for k in range(n)]
    strong = [near[k] and lengths[k] > 0 and (lengths[k] * H.WINDOW >= least or sentences[k]) for k in range(n)]

    def linked(k, step):
        """A strong line, or a heading with one after it, on that side of the stretch."""
        while 0 <= k < n and near[k]:
            if strong[k] or step < 0 and headings[k] and lengths[k]:
                return True
            k += step
        return False
    stretch_has = [near[k] and (linked(k, 1) and any(strong[j] for j in range(k, n) if all(near[k:j + 1]))) for k in range(n)]
    kept = [lengths[k] > 0 and stretch_has[k] and linked(k, -1) for k in range(n)]
    for k in range(n - 1, -1, -1):
        after = next((j for j in range(k + 1, n) if lengths[j]), None)
        kept[k] = kept[k] or bool(lengths[k] and headings[k] and after is not None and kept[after])
    return kept


def test_surges_match_the_plain_rule():
    rng = random.Random(11)
    for _ in range(2000):
        n = rng.randint(0, 14)
        lengths = [rng.choice([0, 0, 3, 8, 20, 40, 90, 200]) for _ in range(n)]
        headings = [rng.random() < 0.2 for _ in range(n)]
        sentences = [rng.random() < 0.3 for _ in range(n)]
        assert H.surges(lengths, headings, sentences) == plain_surges(lengths, headings, sentences), (lengths, headings, sentences)


def test_distribution_decides_inside_an_article_too(monkeypatch):
    long = "A sentence of the article that is as long as such sentences usually are, with a comma. " * 2
    menu = "".join(f"<div>{w}</div>" for w in ("Home", "News", "Sport", "Weather", "Contact", "Archive"))
    links = "".join(f"<li><a href=x>{w}</a></li>" for w in ("Home", "News", "Sport"))
    page = (f"<article><ul>{links}</ul><h1>Title</h1><p>Short</p><p>{long}</p>{menu}<p>{long}</p><ul><li>one egg</li><li>salt</li></ul>"
            f"<p>Done</p><div>Buy now</div><div>\u00a9 2020 Example</div></article>")
    text = long.strip()
    assert H.main_text(page) == "\n\n".join(["Title", "Short", text, text, "one egg", "salt", "Done"])
    monkeypatch.setattr(H, "surges", lambda lengths, headings, sentences: [x > 0 for x in lengths])
    assert "Weather" in H.main_text(page) and "2020" in H.main_text(page)


def test_names_of_wrappers_keep_their_text():
    text = "A sentence of the article that is long enough to be text by itself, and so it is."
    for open_, close in (("<div class='content has-sidebar'>", "</div>"), ("<div class='no-sidebar'>", "</div>"),
                         ("<article class='post category-social'>", "</article>"), ("<article class='tag-advertising'>", "</article>"),
                         ("<section id='related-work'>", "</section>"), ("<div class='side-by-side'>", "</div>"),
                         ("<p class='ad-free'>", "</p>"), ("<p class='share-price'>", "</p>")):
        assert H.main_text(f"<p>{text}</p>{open_}{text}{close}" if open_[1] != "a" else open_ + text + close).endswith(text)
        assert H.main_text(open_ + text + close) == text
    assert H.main_text(f"<article><div class='entry-header'><h2>T</h2></div><p>{text}</p></article>") == "T\n\n" + text
    # A name does not stand against what the element holds.
    menu, notice = "<div class='ad-slot'>buy this</div>", "<div class='cookie-notice'>we use some</div>"
    assert H.main_text(f"<p>Short</p><div class='widget'>{menu}<p>{text}</p></div>{notice}").endswith(text)
    assert "buy" not in H.main_text(f"<p>Short</p><div class='widget'>{menu}<p>{text}</p></div>{notice}")
    assert H.main_text(f"<div class='sidebar-right'>{menu}<article>{text}</article></div><p>other</p>") == text
    # Comments stay out where the article is marked, however long.
    comments = f"<div class='comments'><article>{text * 5}</article></div>"
    assert H.main_text(f"<article>{text}</article>{comments}") == text


def brute_nearest(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 8
          and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in sorted({i for i, _ in ok if i % 20 == 0}):
        a = next(v for i, v in ok if i == q)
        scores = sorted(((-float(v @ a), i) for i, v in ok if i != q))[:k]
        out[q] = [i for _, i in scores], [-s for s, _ in scores]
    return out


@pytest.mark.parametrize("query_block", [N.QUERY_BLOCK, 4])
def test_nearest(spark, monkeypatch, query_block):
    monkeypatch.setattr(N, "QUERY_BLOCK", query_block)
    monkeypatch.setattr(N, "ROWS", 3)
    rng = np.random.default_rng(4)
    v = rng.standard_normal((400, 8)) * rng.uniform(0.1, 3, (400, 1)) + 0.5
    rows = [(i, [float(np.float32(x)) for x in v[i]]) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 460)]  # ties
    rows += [(500, None), (501, [0.0] * 8), (502, [1.0, None] + [1.0] * 6), (503, [float("nan")] + [1.0] * 7),
             (504, [float("inf")] + [1.0] * 7), (505, [1.0] * 3), (None, [1.0] * 8), (13, rows[13][1]), (520, [0.0] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(0)).repartition(5)
    expected = brute_nearest(rows, 20)
    got = {}
    for r in N.nearest(vectors, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, ([], []))[0].append(r.vec_id)
        got[r.query_id][1].append(r.score)
    assert set(got) == set(expected)
    hits = sum(len(set(got[q][0]) & set(expected[q][0])) for q in got)
    assert hits >= 0.98 * 20 * len(got)
    same = [q for q in got if got[q][0] == expected[q][0]]
    assert len(same) > 0.9 * len(got) and all(got[q][1] == pytest.approx(expected[q][1]) for q in same)
    assert N.nearest(vectors.limit(0), F.col("id") % 20 == 0).collect() == []
    few = N.nearest(vectors.where("vec_id between 20 and 24"), F.col("id") % 20 == 0).collect()
    assert [r.rank for r in sorted(few, key=lambda r: r["rank"])] == [1, 2, 3, 4]


def plain_rake(tokens, cells, goals, sweeps=200):
    w = np.ones(len(tokens))
    for _ in range(sweeps):
        for d, goal in enumerate(goals):
            for value, share in goal.items():
                at = [i for i, c in enumerate(cells) if c[d] == value]
                got = sum(tokens[i] * w[i] for i in at)
                if got:
                    w[at] *= share * sum(tokens) / got
    return w


def test_raking_matches_plain_python(spark):
    rng = random.Random(6)
    cells = [(s, lang) for s in ["a", "b", "c", None] for lang in ["x", "y", None]]
    tokens = [rng.randint(1, 500) for _ in cells]
    goals = [{"a": .4, "b": .3, "c": .2, None: .1}, {"x": .5, "y": .2, None: .3}]
    table = spark.createDataFrame([(*c, t) for c, t in zip(cells, tokens)], "source string, lang string, tokens long")
    targets = {d: spark.createDataFrame([(v, s * 7) for v, s in g.items()] + [("none such", 5.0)], f"{d} string, share double")
               for d, g in zip(("source", "lang"), goals)}
    got = {(r.source, r.lang): r.weight for r in M.rake(table, targets, tolerance=1e-9).collect()}
    expected = plain_rake(tokens, cells, goals)
    assert all(got[c] == pytest.approx(w, rel=1e-6) for c, w in zip(cells, expected))


def test_raking_goes_on_until_the_targets_are_met(spark, caplog):
    def raked(rows, sources, tolerance):
        table = spark.createDataFrame(rows, "source string, lang string, tokens long")
        targets = {d: spark.createDataFrame(g, f"{d} string, share double")
                   for d, g in (("source", sources), ("lang", [("x", .5), ("y", .5)]))}
        return {(r.source, r.lang): r.weight * r.tokens for r in M.rake(table, targets, tolerance=tolerance).collect()}
    # Slow: more than 50 sweeps, since few tokens link the two halves.
    got = raked([("a", "x", 1000), ("a", "y", 1), ("b", "x", 1), ("b", "y", 1000)], [("a", .6), ("b", .4)], 1e-6)
    whole = sum(got.values())
    assert got["a", "x"] + got["a", "y"] == pytest.approx(.6 * whole, rel=2e-6)
    assert got["a", "x"] + got["b", "x"] == pytest.approx(.5 * whole, rel=2e-6)
    assert not caplog.records
    # These cannot hold together: it ends, and says what is left.
    assert len(raked([("a", "x", 10), ("b", "y", 10)], [("a", .6), ("b", .4)], 1e-4)) == 2
    assert [r.levelname for r in caplog.records] == ["WARNING"] and "0.25" in caplog.text


def test_mixing_draws_by_probability(spark, odd_docs, no_docs):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "of"]) for _ in range(rng.randint(1, 30))),
             rng.choice("aaaaab"), rng.choice(["en", "en", "de"])) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = M.mix(docs).collect()
    assert len(got) == 2000 and all((M.topic_of(r.text)) == (r.tokens, r.topic) for r in got)
    total = sum(r.tokens for r in got)
    assert sum(r.tokens * r.weight for r in got) == pytest.approx(total)
    assert sum(r.tokens * r.probability for r in got) == pytest.approx(M.BUDGET * total)
    drawn = sum(r.tokens for r in got if r.sampled)
    assert abs(drawn - M.BUDGET * total) < 0.05 * total
    again = {r.doc_id for r in M.mix(docs.repartition(3)).where("sampled").collect()}
    assert again == {r.doc_id for r in got if r.sampled}
    odd = M.mix(odd_docs)
    assert odd.count() == odd_docs.count() and M.mix(no_docs).collect() == []
    assert {r.topic for r in odd.where("doc_id < 4").collect()} == {-1}


def test_texts_bundled_together_are_each_bundled_alone(monkeypatch):
    rng = random.Random(4)
    texts = [None, "", "12", *("".join(rng.choice("abcdefgh é一") for _ in range(rng.randint(1, 400))) for _ in range(40))]
    alone = [L.Profiles(128)(t) for t in texts]
    for together, remembered in ((64, 8192), (7, 8192), (64, 50), (3, 20)):
        monkeypatch.setattr(L, "TOGETHER", together)
        monkeypatch.setattr(L, "REMEMBERED", remembered)
        for a, b in zip(alone, L.Profiles(128).many(texts), strict=True):
            assert (a is None and b is None) or np.array_equal(a, b)
