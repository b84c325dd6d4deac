"""Cases that a cut of the work would lose."""

from __future__ import annotations

import numpy as np

from meshloom.llm import decontam, htmltext, simhash


def test_copies_with_every_fourth_or_random_words_replaced(spark):
    rng = np.random.default_rng(12)
    vocab = [f"w{i}" for i in range(3000)]
    items = [list(rng.choice(vocab, int(n))) for n in rng.integers(4, 60, 30)]
    noise = lambda: list(rng.choice(vocab, int(rng.integers(20, 120))))
    copies = [[("x" if i % 4 == 3 else w) for i, w in enumerate(x)] for x in items]
    copies += [[("y" if rng.random() < share else w) for w in x] for share in (0.2, 0.25, 0.3, 0.33) for x in items]
    copies += [[y for i, w in enumerate(x) for y in ([w] if i % 5 else [w, "z"])] for x in items] + items[:3]
    texts = [" ".join(noise() + x + noise()) for x in copies]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    b = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id int, text string")
    want = {}
    for i, text in enumerate(texts):
        for k, x in enumerate(items):
            s = decontam.align(decontam.tokens(" ".join(x)), decontam.tokens(text)) / (2 * len(x))
            if s >= decontam.LEAK:
                want[i, k] = round(s, 6)
    assert {(r.doc_id, r.item_id): r.score for r in decontam.leaks(d, b).collect()} == want
    assert all((k, k) in want for k, x in enumerate(items) if len(x) >= 20)


def test_rows_without_or_of_one_id_are_told_apart(spark):
    rng = np.random.default_rng(3)
    words = [" ".join(f"w{i}" for i in rng.integers(0, 3000, 60)) for _ in range(8)]
    rows = [(None, words[0]), (None, words[1]), (None, words[1]), (None, words[2]), (5, words[2]), (5, words[3]), (5, words[3]), (6, words[4]), (6, words[5]), (7, words[4]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", "1 AS row", "2 AS doc", "3 AS key")
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    want = [(None, words[0]), (None, words[1]), (5, words[2]), (5, words[3]), (6, words[4]), (6, words[5]), (None, None)]
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted(want, key=key)
    items = spark.createDataFrame([(1, words[1]), (2, words[4])], "item_id int, text string")
    left = decontam.drop_leaks(docs, items)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=key) == sorted((r for r in rows if r[1] not in (words[1], words[4])), key=key)


def test_heading_and_lead_outside_the_main_div():
    body = "<p>One paragraph, of the body, long enough. It goes on, and on.</p>" * 10
    page = f"<body><nav><a href=/>Home</a></nav><main><h1>Title of it</h1><p>Lead, in short, and what it is about.</p><div class=body>{body}</div></main><footer>End.</footer></body>"
    text = htmltext.main_text(page)
    assert text.startswith("Title of it Lead, in short, and what it is about. One paragraph,") and text.endswith("and on.") and text.count("One paragraph") == 10
