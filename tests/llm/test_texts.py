"""Look-alikes, formatting copies, markup, co-occurrence and alignment on small cases and against brute force."""
import itertools
import math
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from lexiloom.llm import alignment, cooccurrence, formatting, lookalike, markup


# --- formatting copies

ROWS = [
    (5, "Hello, world!", "Bonjour le monde."), (3, "hello WORLD", " « bonjour » le\u00a0monde"), (9, "Bonjour, le monde", "Hello world"), (7, "Hello world", "Bonjour le mondé"),
    (1, None, "x"), (2, "X!", None), (4, "", "x"), (6, "--", "X"), (8, None, None), (10, None, None), (11, "123", "4"), (12, "12 3", "4."), (13, "1234", ""), (5, "Hello, world!", "Bonjour le monde."), (None, "Hello world", "Bonjour le monde"),
]


def test_formatting_copies(spark):
    df = spark.createDataFrame([(*r, 0, 0) for r in ROWS], "row_id bigint, en string, fr string, first_id int, n int")
    assert sorted(tuple(r) for r in formatting.formatting_copies(df).collect()) == [(1, 2), (3, 5), (3, 9), (4, 6), (8, 10), (11, 12)]
    assert {r.first_id: r.n_copies for r in formatting.collapse_formatting(df).collect()} == {3: 3, 7: 1, 1: 2, 4: 2, 8: 2, 11: 2, 13: 1}
    assert formatting.formatting_copies(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a", "b", 1), (2, "x", "y", 1), (2, "A", "b", 2)], "row_id bigint, en string, fr string, loaded_at int")
    assert [tuple(r) for r in formatting.formatting_copies(twice).collect()] == [(1, 2)]


def test_formatting_hot_record(spark):
    rows = [(i, "Same text" + "!" * (i % 3), "même") for i in range(3000)] + [(5000 + i, f"t{i}", "u") for i in range(3000)]
    got = formatting.formatting_copies(spark.createDataFrame(rows, "row_id bigint, en string, fr string"))
    assert got.count() == 2999 and got.where("first_id <> 0").count() == 0


def test_colliding_hashes_are_compared(spark, monkeypatch):
    a, b = pa.array(["a b", "É", None, "x", ""]), pa.array(["AB.", "e", None, None, "?"])
    assert formatting.same_text(a, b).tolist() == [True, False, True, False, True]
    long = pa.array(["x" * 300_000 + "y", "ab " * 99_999 + "c", "a" * 70_000])
    other = pa.array(["X-" * 300_000 + "y", "AB" * 99_999 + "d", "a, " * 70_001])
    monkeypatch.setattr(formatting, "STRETCH", 4096)
    assert formatting.same_text(long, other).tolist() == [True, False, False] and formatting.same_text(long, long).all()
    assert (formatting.fingerprints(long) == formatting.fingerprints(other)).tolist() == [True, False, False]
    import pandas as pd

    got = formatting._regroup(pd.DataFrame({"first_id": 1, "row": [4, 5, 6], "en": ["a", "A.", "b"], "fr": ["x", "x", "x"]}))
    assert got[["first_id", "copy_id"]].values.tolist() == [[4, 5]]


# --- look-alikes


def test_lookalikes(spark):
    texts = ["fine café", "ﬁne café", "fine cafe\u0301", "ｆｉｎｅ café", "f\u200bine café", "fine\u00a0café", "finе café", "fine cafe", "Fine café", "self-made", "self‑made", "self–made", "", "\u200b", None, "x²", "x2", "cаfé", "ﬁnе cаfe\u0301"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(0, texts[0], "z"), (None, "fine\u202fcafé", "z")], "id bigint, text string, form string")
    groups = [[0, 1, 2, 3, 4, 5, 6, 18], [9, 10], [12, 13]]
    want = {p for g in groups for p in itertools.combinations(g, 2)}
    got = [tuple(r) for r in lookalike.lookalike_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    unified = {r.id: r.unified for r in lookalike.unify_lookalikes(df.where("id is not null").dropDuplicates(["id"])).collect()}
    assert unified[14] is None and unified[13] == "" and unified[18] == unified[0] and unified[15] == "x²"
    assert lookalike.lookalike_pairs(df.limit(0)).count() == 0


def test_lookalikes_of_a_hot_form(spark):
    """One form with many ids is dealt out; classes and links need no pairs."""
    rows = [(i, "fine café") for i in range(300)] + [(1000 + i, "ﬁne café") for i in range(7)] + [(2000, "fine cafe\u0301"), (2000, "other"), (5, "ﬁne café")] + [(3000 + i, f"plain {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, text string")
    forms = {}
    for i, t in rows:
        if "plain" not in t and t != "other":
            forms.setdefault(t, set()).add(i)
    want = {(min(a, b), max(a, b)) for x, y in itertools.combinations(forms.values(), 2) for a in x for b in y if a != b}
    got = [tuple(r) for r in lookalike.lookalike_pairs(df, replica_rows=40).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    links = {r.id: (r.class_id, r.n_links) for r in lookalike.lookalike_classes(df).collect()}
    assert set(links) == set().union(*forms.values()) and {c for c, _ in links.values()} == {0} and links[7] == (0, 9) and links[1000][1] == 301


def test_representatives_follow_the_corpus():
    table = lookalike.rewriting({"é": 1, "e\u0301": 9, "е": 50, "e": 3, "\u200b": 4})
    assert table["é"] == "e\u0301" and table["e"] == "е" and table["\u200b"] == ""
    write = lookalike.Rewriter(table)
    assert write("é e\u0301 e") == write("e\u0301 é е") and write(write("é e")) == write("é e")


# --- markup

CASES = {
    "markdown": (
        "---\ntitle: x\nkeep: |\n  - no\n---\n\n# Head *one* &amp; two #\n\nSetext\n------\n\nA year\n1869. not an item $x+1$ and \\$5, $52 and $61.\n\n- a **b**\n- c\n  d\n    - nested [l](http://x)\n\n9) nine\n\n```py\n# no\n```\n\n    indented\n\n$$\nE = mc^2\n$$\n\n<!--\n## no\n- no\n-->\n\n* * *\n\n<h3>Html <em>h</em></h3>\n\n`$no$` and [u]{.underline}.\n\n> ## In quote\n",
        [("heading", "Head one & two"), ("heading", "Setext"), ("formula", "x+1"), ("list_item", "a b"), ("list_item", "c d"), ("list_item", "nested l"), ("list_item", "nine"), ("code", "# no"), ("code", "indented"), ("formula", "E = mc^2"), ("heading", "Html h"), ("heading", "In quote")],
    ),
    "html": (
        "<!DOCTYPE html><html><head><title>t</title><style>h2 {}</style></head><body><H2 class=\"a\">A &eacute; <b>b</b></H2><script>'<li>x</li>'</script><ul><li>one<li>two <a href=x>link</a><ul><li>in</li></ul></li></ul><pre><code class=\"x\">a &lt; b\n  c</code></pre><p>Take \\(x &lt; 1\\) or $5 and $6<p><div>$$y$$</div><!-- <h1>no</h1> --><p><code>\\(no\\)</code></body></html>",
        [("heading", "A é b"), ("list_item", "one"), ("list_item", "two link"), ("list_item", "in"), ("code", "a < b c"), ("formula", "x < 1"), ("formula", "y")],
    ),
    "wiki": (
        "== A ''b'' [[X|c]] ==\n\n* one [http://x two]\n** in\n# num\n:<math>x</math>\n\n<nowiki>== no ==</nowiki>\n\n<pre>\n* &lt;no&gt;\n</pre>\n{| class=x\n| * no\n|}\n{{Infobox\n| a = b\n}}\n<!-- == no == -->\nText.<ref>note</ref>\n",
        [("heading", "A b c"), ("list_item", "one two"), ("list_item", "in"), ("list_item", "num"), ("formula", "x"), ("code", "* <no>")],
    ),
    "latex": (
        "\\documentclass{book}\n\\begin{document}\n\\section*{Caf\\'e \\& \\textbf{b}}\\label{x}\n% \\section{no}\nIt cost \\$5; $a_{1}$.\n\\begin{itemize}\n \\item one\\footnote{no}\n \\begin{enumerate}\\item in\\end{enumerate}\n \\item 5\\% \\href{u}{t}\n\\end{itemize}\n\\begin{verbatim}\n\\section{no} $x$\n\\end{verbatim}\n\\begin{equation*}\nz\n\\end{equation*}\n\\[w\\]\n\\end{document}",
        [("heading", "Café & b"), ("formula", "a_{1}"), ("list_item", "one"), ("list_item", "in"), ("list_item", "5% t"), ("code", "\\section{no} $x$"), ("formula", "z"), ("formula", "w")],
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_elements(name):
    text, want = CASES[name]
    assert markup.dialect(text) == name
    assert sorted(markup.elements(text)) == sorted(want)
    assert sorted(markup.elements(text.replace("\n", "\r\n"))) == sorted(want)


def test_unmarked_and_odd_texts():
    assert markup.elements("We found that 5 * 3 * 2 makes 30 and 7 < 9.\n\nPaid $4 to the ferryman (item # 12).\n\nRead on [page 9], {pause}, notes_de_lecture_2.") == []
    for text in (None, "", "  \n", "<", "\\", "$", "{{", "[[", "```", "- ", "\\begin{itemize}", "<ul><li>", "#" * 9, ">" * 500, "- " * 3000, "{" * 5000, "<div>" * 3000):
        markup.elements(text)
        markup.clean_text(text)
    assert markup.clean_text(None) is None and markup.clean_text("# A\n\n- b\n\n$$c$$") == "# A\n\n- b\n\n$$ c $$"


def test_scoring_decides_what_is_content():
    """Navigation, a sidebar and a link list, planted around and inside the content, go by score; with scoring off they stay."""
    links = lambda n: "".join(f"<li><a href=x>Page {i}</a></li>" for i in range(n))
    body = f"<div><h1>Title</h1><p>{'Long, real, text with commas. ' * 20}</p><ul><li>kept</li><li>see <a href=y>this</a> too</li></ul>"
    want = [("heading", "Title"), ("list_item", "kept"), ("list_item", "see this too")]
    side = f"<aside><h3><a href=x>More</a></h3><ul>{links(4)}</ul></aside>"
    planted = {
        "navigation": f"<html><body><nav><ul>{links(20)}</ul></nav>{body}</div></body></html>",
        "sidebar": f"<html><body><div>{body}</div></div>{side}</body></html>",
        "sidebar inside": f"<html><body>{body}{side}</div></body></html>",
        "link list": f"<html><body>{body}<ul>{links(5)}</ul></div></body></html>",
        "link list of a page": f"# Title\n\n{'Long, real, text with commas. ' * 20}\n\n- kept\n- see [this](y) too\n\nOn\n\n- [Page 1](x)\n- [Page 2](x)\n- [Page 3](x)\n",
    }
    for name, text in planted.items():
        assert sorted(markup.elements(text)) == sorted(want), name
        assert len(markup.elements(text, scoring=False)) > len(want), name
    # siblings with text of their own, a list of two links, and a page that is nothing but links are content
    assert len(markup.elements(f"<html><body>{body}</div><div><h2>Second</h2><p>Short.</p></div><ul>{links(2)}</ul></body></html>")) == len(want) + 3
    assert len(markup.elements(f"<ul>{links(6)}</ul>")) == 6


def test_depth_and_length_are_no_limit():
    deep = "".join("  " * i + f"- item {i}\n" for i in range(90))
    assert [x for k, x in markup.elements(deep) if k == "list_item"] == [f"item {i}" for i in range(90)]
    assert markup.elements("- " * 50_000 + "x") == [("list_item", "x")] and markup.elements("> " * 50_000 + "# x") == [("heading", "x")]
    assert markup.elements("\\begin{document}\n\\section{" + "\\href{u}{" * 300 + "x" + "}" * 300 + "}\n\\end{document}") == [("heading", "x")]
    assert markup.elements("== A ==\n" + "{{x|" * 3000 + "}}" * 3000 + "\n* b\n" + "{|\n" * 50 + "| * no\n" + "|}\n" * 50) == [("heading", "A"), ("list_item", "b")]


def test_the_whole_text_tells_its_dialect():
    comment = "<!-- " + "licence " * 1000 + "-->\n"
    assert markup.dialect(comment + "<!DOCTYPE html><html><body><h1>x</h1></body></html>") == "html"
    assert markup.dialect("% " + "licence " * 1000 + "\n\\documentclass{book}\n\\begin{document}x\\end{document}") == "latex"
    assert markup.dialect("# Head\n\n```\n\\documentclass{book}\n<html>\n```\n\n- item\n") == "markdown"


def test_markup_frames(spark):
    df = spark.createDataFrame([(1, "# A\n\n# A", "k"), (2, None, "k"), (3, "", "k"), (None, "# B", "k")], "interior_id bigint, text string, kind string")
    assert sorted((tuple(r) for r in markup.markup_elements(df).collect()), key=str) == sorted([(1, "heading", "A"), (None, "heading", "B")], key=str)
    assert markup.markup_clean(df).count() == 4


# --- co-occurrence


def test_counts_and_lift(spark):
    rows = [(i, ["a", "a", "b"], ["x"]) for i in range(6)] + [(i, ["c"], ["y"]) for i in range(6, 60)] + [(60, None, []), (61, [], None), (0, ["a"], ["x", None]), (None, ["a"], ["x"])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "pair_id bigint, stems_en array<string>, stems_fr array<string>, n_ab int")
    got = {(r.left, r.right): r for r in cooccurrence.cooccurring(df).collect()}
    assert set(got) == {("a", "x"), ("b", "x"), ("c", "y")}
    r = got["a", "x"]
    assert (r.n_ab, r.n_a, r.n_b, r.n_records) == (6, 6, 6, 62) and r.lift == pytest.approx(62 / 6)
    assert r.p_value < 1e-3 and r.q_value >= r.p_value * 0.9
    assert {(r.left, r.right) for r in cooccurrence.cooccurring(df, min_count=5, min_lift=6).collect()} == {("a", "x"), ("b", "x")}
    assert cooccurrence.cooccurring(df.limit(0)).count() == 0
    assert cooccurrence.translations(df).count() == 6


def test_one_record_with_half_of_all_items(spark):
    rows = [(0, [f"e{i}" for i in range(400)], [f"f{i}" for i in range(400)])] + [(k, [f"e{k}"], [f"f{k}"]) for k in range(1, 400)]
    df = spark.createDataFrame(rows, "pair_id bigint, stems_en array<string>, stems_fr array<string>")
    plain = {(r.left, r.right): tuple(r) for r in cooccurrence.cooccurring(df).collect()}
    split = {(r.left, r.right): tuple(r) for r in cooccurrence.cooccurring(df, replica_rows=50).collect()}
    assert len(plain) == 400 * 400 and split == plain and plain["e7", "f7"][2] == 2


def test_found_by_count_and_lift_alone(spark, tmp_path):
    """Few large among many small records, or many empty ones: the fitted null expects joint counts far above n_a * n_b / N."""
    from lexiloom.llm import catalog

    rng = random.Random(4)
    stems = lambda lang, n: [f"{lang}{min(int(rng.expovariate(0.02)), 299)}" for _ in range(n)]
    for name, sizes in {"heavy": [2] * 900 + [50] * 100, "empty": [0] * 700 + [6] * 300}.items():
        records = [(i, stems("e", n), stems("f", n)) for i, n in enumerate(sizes)]
        spark.createDataFrame(records, "pair_id bigint, stems_en array<string>, stems_fr array<string>").write.parquet(str(tmp_path / name / "pair_stems.parquet"))
        sides = [[set(r[k]) for r in records] for k in (1, 2)]
        alone = [{s: sum(s in x for x in side) for s in set().union(*side)} for side in sides]
        joint = {}
        for a, b in zip(*sides):
            for p in itertools.product(a, b):
                joint[p] = joint.get(p, 0) + 1
        want = {(f"en:{a}", f"fr:{b}") for (a, b), n in joint.items() if n >= 5 and n * len(records) >= 6 * alone[0][a] * alone[1][b]}
        got = [tuple(r) for r in catalog.p2_found(spark, str(tmp_path / name)).collect()]
        assert want and len(got) == len(set(got)) and set(got) == want, name


def test_tail_against_convolution():
    rng = np.random.default_rng(5)
    chance, number = rng.uniform(0, 0.3, (4, 6)), rng.integers(1, 8, 6).astype(float)
    for row in chance:
        pmf = np.ones(1)
        for p, m in zip(row, number):
            for _ in range(int(m)):
                pmf = np.convolve(pmf, [1 - p, p])
        ks = np.arange(math.ceil((row * number).sum()) + 1, len(pmf) - 2)[:8].astype(float)
        mean, got = cooccurrence.tail(ks, np.tile(row, (len(ks), 1)), number)
        exact = np.array([pmf[int(k) :].sum() for k in ks])
        assert mean[0] == pytest.approx((row * number).sum()) and np.all(np.abs(np.log(got / exact)) < 0.12)


def test_fit_meets_its_margins():
    sizes, records, frequencies, items = np.array([2.0, 5.0]), np.array([30.0, 10.0]), np.array([1.0, 10.0]), np.array([10.0, 10.0])
    y = cooccurrence.fit(sizes, records, frequencies, items)
    x = cooccurrence.item_strength(frequencies, y, records)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert (p @ records) == pytest.approx(frequencies, rel=1e-3) and (items @ p) == pytest.approx(sizes, rel=1e-3)


# --- alignment

NOUNS = dict(zip("light house river mountain bread king stone letter garden night water horse bridge child wolf".split(), "lumière maison rivière montagne pain roi pierre lettre jardin nuit eau cheval pont enfant loup".split()))
VERBS = dict(zip("saw found lost built feared loved burned carried".split(), "vit trouva perdit bâtit craignit aima brûla porta".split()))


def sentence(rng):
    a, b, c = rng.sample(list(NOUNS), 3)
    v = rng.choice(list(VERBS))
    return f"The {a} {v} the {b} near the {c}.", f"Le {NOUNS[a]} {VERBS[v]} la {NOUNS[b]} près du {NOUNS[c]}."


def test_alignment(spark):
    rng = random.Random(4)
    pairs = [sentence(rng) for _ in range(600)]
    training = spark.createDataFrame([(f, e) if i % 9 == 0 else (e, f) for i, (e, f) in enumerate(pairs[:400])] + [(None, "x"), ("y", None)], "en string, fr string")
    story = list(dict.fromkeys(sentence(rng) for _ in range(40)))
    en, fr, want = [], [], set()
    i = 0
    while i < len(story):
        e, f = story[i]
        if i % 10 == 3:
            en.append(e)  # left out in French
        elif i % 10 == 6 and i + 1 < len(story):
            en += [e, story[i + 1][0]]
            fr.append(f + " " + story[i + 1][1])
            want |= {(len(en) - 1, len(fr)), (len(en), len(fr))}
            i += 1
        elif i % 10 == 8 and i + 1 < len(story):
            en += [e, story[i + 1][0]]
            fr += [story[i + 1][1], f]
            want |= {(len(en) - 1, len(fr)), (len(en), len(fr) - 1)}
            i += 1
        else:
            en.append(e)
            fr.append(f)
            want.add((len(en), len(fr)))
        i += 1
    books = spark.createDataFrame([(2, "Tale (FR)", 1), (1, "Tale (EN)", 1), (3, "Alone (EN)", 1), (4, None, 1)], "id bigint, title string, side int")
    segments = spark.createDataFrame(
        [(100 + k, 1, k, t, 0) for k, t in enumerate(en, 1)] + [(500 + k, 2, k, t, 0) for k, t in enumerate(fr, 1)] + [(101, 1, 1, en[0], 0), (900, 3, 1, en[0], 0), (901, None, 1, "x", 0), (902, 1, 99, None, 0), (903, 2, 98, "", 0)],
        "id bigint, book_id bigint, position int, text string, work int",
    )
    got = {(r.segment_en - 100, r.segment_fr - 500) for r in alignment.align(books, segments, training).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got), (want - got, got - want)
    assert alignment.align(books, segments.limit(0), training).count() == 0


def test_large_works_are_compared_by_cells(spark):
    rng = random.Random(8)
    training = spark.createDataFrame([sentence(rng) for _ in range(400)], "en string, fr string")
    story = [(e.replace(".", f", {1000 + 7 * k}."), f.replace(".", f", {1000 + 7 * k}.")) for k, (e, f) in enumerate(sentence(rng) for _ in range(1400))]
    kept = [k for k in range(1400) if k % 11 or k < 300]
    books = spark.createDataFrame([(1, "Tale (EN)"), (2, "Tale (FR)")], "id bigint, title string")
    segments = spark.createDataFrame([(k, 1, k + 1, e) for k, (e, _) in enumerate(story)] + [(10_000 + k, 2, n + 1, story[k][1]) for n, k in enumerate(kept)], "id bigint, book_id bigint, position int, text string")
    got = {(r.segment_en, r.segment_fr - 10_000) for r in alignment.align(books, segments, training).collect()}
    right = {(k, k) for k in kept}
    assert len(got & right) >= 0.97 * len(right) and len(got & right) >= 0.97 * len(got)


@pytest.mark.parametrize("move", [50, 200])
def test_single_sentences_moved_far(spark, move):
    """In a work compared whole, a sentence and its rendering may stand any number of places apart."""
    rng = random.Random(21)
    training = spark.createDataFrame([sentence(rng) for _ in range(400)], "en string, fr string")
    story = list(dict.fromkeys(sentence(rng) for _ in range(320)))
    order = list(range(len(story)))
    moved = [30, 60, 90]
    for k in moved:
        order.remove(k)
        order.insert(k + move, k)
    books = spark.createDataFrame([(1, "Tale (EN)"), (2, "Tale (FR)")], "id bigint, title string")
    segments = spark.createDataFrame([(k, 1, k + 1, e) for k, (e, _) in enumerate(story)] + [(10_000 + k, 2, n + 1, story[k][1]) for n, k in enumerate(order)], "id bigint, book_id bigint, position int, text string")
    got = {(r.segment_en, r.segment_fr - 10_000) for r in alignment.align(books, segments, training).collect()}
    right = {(k, k) for k in order}
    assert {(k, k) for k in moved} <= got and len(got & right) >= 0.97 * len(right) and len(got & right) >= 0.97 * len(got), (right - got, got - right)


def test_single_sentences_moved_out_of_reach_of_their_cell(spark):
    """In a large work what the cells leave over is looked up in the whole other version."""
    rng = random.Random(22)
    training = spark.createDataFrame([sentence(rng) for _ in range(400)], "en string, fr string")
    story = [(e.replace(".", f", {1000 + 7 * k}."), f.replace(".", f", {1000 + 7 * k}.")) for k, (e, f) in enumerate(sentence(rng) for _ in range(1400))]
    order, moved = list(range(1400)), {100: 1200, 700: 60, 900: 500}
    for k, to in moved.items():
        order.remove(k)
        order.insert(to, k)
    books = spark.createDataFrame([(1, "Tale (EN)"), (2, "Tale (FR)")], "id bigint, title string")
    segments = spark.createDataFrame([(k, 1, k + 1, e) for k, (e, _) in enumerate(story)] + [(10_000 + k, 2, n + 1, story[k][1]) for n, k in enumerate(order)], "id bigint, book_id bigint, position int, text string")
    got = {(r.segment_en, r.segment_fr - 10_000) for r in alignment.align(books, segments, training).collect()}
    right = {(k, k) for k in order}
    assert {(k, k) for k in moved} <= got and len(got & right) >= 0.97 * len(right) and len(got & right) >= 0.97 * len(got), (right - got, got - right)


def test_clauses_and_terms():
    assert alignment.clauses('He came. "She left," he said; it rained.') == [["he", "came"], ["she", "left", "he", "said"], ["it", "rained"]]
    assert alignment.clauses("A b, and c d e f. \nG… H!") == [["a", "b"], ["c", "d", "e", "f"], ["g"], ["h"]]
    assert alignment.terms("Ｔhe Œuvre е́té 6 570, twelve") == ["the", "oeuvre", "ete", "6570", "twelve"]
    assert alignment.terms(None) == [] and alignment.clauses(None) == [] and alignment.clauses(" ?! ") == []
    both = alignment.Words.of(["a. b c", None, "", "d"])
    assert [both.names[c] for c in both.codes] == ["a", "b", "c", "d"] and both.row.tolist() == [0, 0, 3] and both.parts().tolist() == [0, 1, 0]


def test_terms_beyond_the_decomposition_are_projected(spark):
    """With a vocabulary of a few terms all others still find their translations, since they stand in the same pairs."""
    rng = random.Random(3)
    training = spark.createDataFrame([sentence(rng) for _ in range(500)], "en string, fr string")
    space = alignment.learn(training, "en", "fr", vocabulary=4)
    assert [len(v) for v in space.vectors] == [4, 4]
    en, fr = list(NOUNS), [alignment.terms(x)[0] for x in NOUNS.values()]
    like = space.lookup(en, 0)[0] @ space.lookup(fr, 1)[0].T
    outside = [i for i, (a, b) in enumerate(zip(en, fr)) if space.index[0][a] >= 4 and space.index[1][b] >= 4]
    assert len(outside) > 10 and all(like[i].argmax() == i and like[i, i] > 0.8 for i in outside)
    assert space.lookup(["xyzzy"], 0)[0] @ space.lookup(["xyzzy"], 1)[0].T == pytest.approx(1)


