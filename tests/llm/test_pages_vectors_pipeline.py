"""HTML extraction, embedding near-duplicates and the pipeline."""

import math

import numpy as np
import pytest

from tidelog.llm import cells, html, vectors
from tidelog.llm.common import cut
from tidelog.llm.queries import QUERIES


@pytest.fixture(scope="module")
def model():
    return html.trained()


def test_unseen_pages_are_labelled(model):
    r = np.random.default_rng(1234)
    right = total = 0
    for _ in range(100):
        page, main = html.write_page(r)
        found = html.blocks(page)
        want = "\n".join(t for t, _, _ in found if t in main)
        right += html.main_text(model, [page])[0] == want
        total += 1
    assert right / total > 0.9


def test_blocks_decode_and_join_white_space(model):
    page = "<html><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>one\n\t two&nbsp;three<br>four</p><!-- x --><script>if(a<b)'</p>'</script><p>&lt;five&gt;</article><footer>&copy; z</footer>"
    assert html.main_text(model, [page]) == ["A & B\none two three four\n<five>"]


def test_nothing_after_unclosed_elements_is_lost(model):
    form = "<form><input list=x><datalist id=x><option value=A><option value=B></datalist></form>"
    article = "<article><h1>A title</h1><p>Words of the article, which go on for a while.</p><p>More words of the article follow here.</p></article>"
    want = "A title\nWords of the article, which go on for a while.\nMore words of the article follow here."
    for before in (form, "<object data=a>", "<canvas>", "<svg>", "<math>", "<select><option>", "<noscript>", "<template>", "<textarea>", "<script>"):
        page = f"<html><body>{before}{article}</body></html>"
        assert [t for t, _, _ in html.blocks(page)][-3:] == want.split("\n"), before
    assert html.main_text(model, [f"<html><body>{form}{article}</body></html>"]) == [want]


def test_formulas_drawings_and_choices():
    words = lambda page: [t for t, _, _ in html.blocks(page)]
    formula = "<math><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></mrow><annotation>E=mc^2</annotation></semantics></math>"
    assert words(f"<p>Here {formula} holds.</p>") == ["Here E=mc2 holds."]
    assert words("<p>See <svg><title>icon</title><g><path d='M0'/><path d='M1'/></g></svg> here.</p><p>Next</p>") == ["See here.", "Next"]
    found = html.blocks("<p>Sales <svg><text>May</text><text>June</text></svg> rose.</p>")
    assert [(t, [n[0] for n in node.path()]) for t, node, _ in found] == [("Sales", ["p"]), ("May", ["p", "svg", "text"]), ("June", ["p", "svg", "text"]), ("rose.", ["p"])]
    assert words("<p>Colour</p><select><option>Red<option>Blue</select><p>Done <object data=a>Its text</object></p>") == ["Colour", "Red", "Blue", "Done", "Its text"]


def test_broken_markup_takes_linear_time():
    import time

    for piece in ("<a ", "<", "</", "<a x=\"", "<a x='>", "<!x ", "<!-", "<p><", "</x>", "<div>", "<div>x", "<b x=\"y", "a=<i '", "<" + "a" * 7, "&", "<svg><title>", "<p class=\"" + "c " * 50 + "\">t"):
        began = time.perf_counter()
        found = html.blocks((piece * (1_000_000 // len(piece)))[:1_000_000] + "<p>end</p>")
        assert time.perf_counter() - began < 20, piece
        assert "end" in found[-1][0], piece


def test_deep_pages_keep_their_outer_elements(model):
    page = "<html><body><nav class='menu'>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</nav><p>after</p>"
    (deep, node, _), (after, own, _) = html.blocks(page)
    assert [n[0] for n in node.path()][:3] == ["html", "body", "nav"] and len(node.path()) == 3003
    assert [n[0] for n in own.path()] == ["html", "body", "p"] and (deep, after) == ("deep", "after")
    many = " ".join(f"c{k}" for k in range(40))
    assert html.blocks(f"<p class='{many}'>x")[0][1].names == ("p", *many.split())


def test_quotes_hide_ends_of_tags_only_in_values():
    words = lambda page: [t for t, _, _ in html.blocks(page)]
    assert words("<p title='a > b' data-x=\"c > d\">one</p>") == ["one"]
    assert words("<p data-x=don't>one</p><p>it's two</p>") == ["one", "it's two"]
    assert words("<p title=\"open>one</p><p>two</p>") == ["one", "two"]
    assert words("<p>one < two <3 > four</p>") == ["one < two <3 > four"]
    assert words("x <!-- open <p>y") == ["x"] and words("a <b") == ["a <b"] and words("a <![CDATA[<p>&amp;]]> b") == ["a <p>&amp; b"]


def test_pages_of_the_table_by_their_articles(spark, model):
    """The pages of the table are written around articles whose blocks stand between an element that opens and closes the
    article; a plain reading of that element, without any learned part, gives the same text on nearly all pages."""
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages), model).collect()}
    assert len(got) == len(pages)
    same = seen = 0
    for r in pages:
        inner = re.search(r"<article[^>]*>(.*?)</article>", r.html or "", re.S)
        if inner:
            seen += 1
            # what is not of the article inside it: lines of the brute reading that the labeller left out
            want = [t for t, _, _ in html.blocks(inner[1])]
            mine = got[r.page_id].split("\n")
            same += set(mine) <= set(want) and len(mine) >= 0.5 * len(want)
    assert seen and same >= 0.95 * seen


def test_odd_pages(spark, model):
    schema = "page_id long, url string, html string, text string, path string"
    odd = [(1, None, None, "t", "p"), (2, "u", "", "t", "p"), (3, "u", "<p>" * 3000 + "x", "t", "p"), (3, "u", "<<<>>> & < a", None, None), (None, None, "<div " + "x" * 1000, "t", "p")]
    got = html.extract(spark.createDataFrame(odd, schema), model).collect()
    assert len(got) == len(odd) and all(r.n_chars == len(r.text) for r in got)
    assert html.extract(spark.createDataFrame([], schema), model).collect() == []


def test_gradients():
    """The backward pass against differences."""
    r = np.random.default_rng(0)
    z, u = r.standard_normal((4, 2, 4 * html.HIDDEN)).astype(np.float32), (r.standard_normal((html.HIDDEN, 4 * html.HIDDEN)) * 0.3).astype(np.float32)
    mask = np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    w = r.standard_normal((4, 2, html.HIDDEN)).astype(np.float32)
    _, saved = html._lstm(z, u, mask)
    dz, du = html._back(w * mask[:, :, None], u, mask, saved)
    loss = lambda z, u: float((html._lstm(z, u, mask)[0] * w * mask[:, :, None]).sum(dtype=np.float64))
    for at in [(0, 0, 3), (1, 1, 20), (3, 0, 50)]:
        d = np.zeros_like(z)
        d[at] = 1e-2
        assert abs((loss(z + d, u) - loss(z - d, u)) / 2e-2 - dz[at]) < 2e-2
    d = np.zeros_like(u)
    d[2, 9] = 1e-2
    assert abs((loss(z, u + d) - loss(z, u - d)) / 2e-2 - du[2, 9]) < 2e-2


def brute_vectors(rows):
    """(row, links, least id reachable) of the usable rows, by all pairs."""
    ok = [(k, i, np.array(v, float), l) for k, (i, v, l) in enumerate(rows) if i is not None and l is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    near = {k: [] for k, *_ in ok}
    for size in {len(v) for _, _, v, _ in ok}:
        part = [x for x in ok if len(x[2]) == size]
        m = np.array([v for _, _, v, _ in part])
        m = m / np.linalg.norm(m, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(m @ m.T >= 0.98)):
            if a != b and part[a][3] == part[b][3]:
                near[part[a][0]].append(part[b][0])
    least = {k: i for k, i, *_ in ok}
    changed = True
    while changed:
        changed = False
        for a, bs in near.items():
            m = min([least[a], *(least[b] for b in bs)])
            if m < least[a]:
                least[a], changed = m, True
    return {k: (i, len(near[k]), least[k]) for k, i, *_ in ok}


def check_vectors(spark, rows):
    """Every row against all pairs, its place told by an extra column's name that the operator must not mind."""
    df = spark.createDataFrame([(a, b, c, "x", "y", 1, 2) for a, b, c in rows], "vec_id long, embedding array<float>, label int, uid string, cell string, h1 int, pid int")
    want = brute_vectors(rows)
    want = [want.get(k, (i, 0, i)) for k, (i, _, _) in enumerate(rows)]
    got = vectors.near_duplicates(df).collect()
    order = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((x.vec_id, x.n_links, x.component_id) for x in got), key=order) == sorted(want, key=order)
    assert all(x.kept == (x.vec_id is not None and x.vec_id == x.component_id) for x in got)
    return df


def test_vectors_against_brute_force(spark):
    r = np.random.default_rng(5)
    centre = r.standard_normal((30, 24))
    rows = []
    for i in range(600):
        v = centre[i % 30] + r.standard_normal(24) * r.choice([0, 0.05, 0.15, 0.4])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 2)))
    rows += [(700, None, 1), (701, [0.0] * 24, 1), (702, [math.nan] * 24, 1), (703, [None] * 24, 1), (704, rows[0][1], None), (None, rows[0][1], 0), (706, [], 0), (707, [1.0, 2.0], 0), (708, [2.0, 4.0], 0), (709, [math.inf] + [1.0] * 23, 0), (0, rows[0][1], 0), (710, [0.0, 1.0], 1), (711, [-0.0, 1.0], 1)]
    df = check_vectors(spark, rows)
    assert vectors.near_duplicates(df.limit(0)).collect() == []


def test_unlike_vectors_of_one_id(spark):
    """Rows that repeat an id are vectors of their own: each has its own links."""
    a, b, c = ([1.0] + [0.0] * 7, [0.0, 1.0] + [0.0] * 6, [0.0] * 7 + [1.0])
    near = lambda v: [x + 0.01 for x in v]
    check_vectors(spark, [(1, a, 0), (1, b, 0), (2, near(a), 0), (3, near(b), 0), (1, c, 1), (1, near(c), 1), (4, near(c), 0), (1, a, 0)])


def test_a_cell_that_is_divided(spark):
    """More near copies than a block holds, all of them in the same cells."""
    r = np.random.default_rng(8)
    centre = r.standard_normal(16)
    rows = [(i, [float(x) for x in (centre + r.standard_normal(16) * 0.06).astype(np.float32)], 0) for i in range(1500)]
    assert 1500 > cells.LIMIT
    check_vectors(spark, rows)


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(6)
    a = vectors.unit(r.standard_normal((3000, 64)))  # the estimate is unbiased over directions, so each pair has its own
    b = vectors.unit(a + r.standard_normal((3000, 64)) * 0.1)
    tables, bits = vectors.grid(5000)
    both = vectors.Codes.of(np.concatenate([a, b]), tables, bits)
    again = vectors.Codes.unpack(both.pack(), 64, tables)
    for name in ("factor", "low", "step", "signs", "rounded", "cells"):
        assert (getattr(both, name) == getattr(again, name)).all()
    found, bound = vectors.estimates(again, np.arange(3000), np.arange(3000) + 3000)
    error = found - (a * b).sum(1)
    assert abs(error.mean()) < 0.01 and (np.abs(error) <= bound).mean() > 0.999


def test_pairs_at_the_threshold_meet_in_a_cell():
    r = np.random.default_rng(7)
    for points in (10, 5_000, 10**6, 10**9):
        tables, bits = vectors.grid(points)
        assert vectors.recall(tables, bits) > 0.9998 and tables <= 64
        a = vectors.unit(r.standard_normal((2000, 64)))
        side = r.standard_normal((2000, 64))
        side = vectors.unit(side - (side * a).sum(1, keepdims=True) * a)
        b = 0.98 * a + math.sqrt(1 - 0.98**2) * side
        same = vectors.cell_codes(a, tables, bits) == vectors.cell_codes(b, tables, bits)
        assert same.any(1).mean() > 0.999


def test_pipeline_against_brute_force(spark, sf_dir):
    from zlib import crc32

    import public_tokenizers as P
    from tokenizers import Tokenizer

    import corpus_pipeline
    from tidelog.llm import quality, secret_scan, simhash

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    of = quality.scorer(quality.fit(spark, docs, sf_dir))
    kept = {i: t for i, t in kept.items() if of(t) >= 0.3}
    kept = {i: t for i, t in kept.items() if i == max(j for j, u in kept.items() if u == t)}
    prints = {i: simhash.fingerprint(t) for i, t in kept.items()}
    root = {i: i for i in kept}
    changed = True
    while changed:
        changed = False
        for i in kept:
            least = min(root[j] for j in kept if (prints[i] ^ prints[j]).bit_count() <= 4)
            if least < root[i]:
                root[i], changed = least, True
    kept = {i: secret_scan.redact_text(t, secret_scan.dictionary(P.path("byte_bpe_50k.tiktoken"))) for i, t in kept.items() if root[i] == i}
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = set()
    for i, t in kept.items():
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        want |= {(i, k, a, b - a, crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    fill: dict = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 1024


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    from .conftest import ODD, text_rows

    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = ODD + [(20, "x y z and more words here"), (21, "x y z and more words here"), (8, "token = abcdef123456"), (None, None)]
    text_rows(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # one class only: nothing is rejected; of equal texts the largest id stays, of empty ones the row of the id that has one;
    # texts without words are one group of near copies
    assert {r.doc_id for r in got} == {2, 3, 5, 7, 8, 21}
    empty = tmp_path / "empty"
    text_rows(spark, []).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, str(empty)).collect() == []


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = cut(stage(spark, before, sf_dir), "stage")
        assert after.dtypes == docs.dtypes, name
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        before = after
    texts = [r.text for r in before.collect()]
    assert len(texts) == len(set(texts)) and not any('token = "' in t for t in texts)


def test_queries_run_on_the_smallest_tables(spark, sf_dir):
    n = {"op6_html_text": "pages", "op7_embedding_dedup": "embeddings"}
    for name, f in QUERIES.items():
        got, want = f(spark, sf_dir).count(), spark.read.parquet(f"{sf_dir}/{n.get(name, 'documents')}.parquet").count()
        assert got == want or name == "op8_packing" and got > want
