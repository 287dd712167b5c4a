import pytest
from conftest import rows_of

from sluicebox.llm.queries import QUERIES, SQL, TOKENIZERS

COLUMNS = {
    "p2_found": ["category", "rank", "product_name"], "p4_found": ["row_id", "field", "canonical"], "p6_found": ["row_id"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
}


def stated_errors(frame, duck):
    """p1: estimates of the total and of single days within five standard errors of the exact counts."""
    exact = dict(duck.execute("SELECT CAST(DATE '1970-01-01' + CAST(floor(sale_date / 86400) AS INT) AS VARCHAR), count(DISTINCT order_id) FROM clean_sales GROUP BY 1").fetchall())
    days = frame[frame.level == "day"]
    assert len(days) == len(exact)
    for day, estimate, error in zip(days.day, days.estimate, days.std_error):
        assert abs(estimate - exact[day]) <= max(5 * error * exact[day], 3)


def merged_batches(frame, duck):
    exact = dict(duck.execute("SELECT category, count(DISTINCT order_id) FROM clean_sales WHERE category IS NOT NULL GROUP BY 1").fetchall())
    assert set(frame.category) == set(exact)
    assert all(abs(e - exact[c]) <= max(5 * s * exact[c], 3) for c, e, s in zip(frame.category, frame.estimate, frame.std_error))


def percentile_ranks(frame, duck):
    rows = frame[frame.batch_id.isna()] if "batch_id" in frame else frame
    assert len(rows)
    for category, column, share, value, error in rows[["category", "column", "share", "value", "rank_error"]].itertuples(index=False):
        low, high = duck.execute(f"SELECT avg(({column} < ? * (1 - 2e-5))::INT), avg(({column} <= ? * (1 + 2e-5))::INT) FROM clean_sales WHERE category IS NOT DISTINCT FROM ? AND {column} IS NOT NULL", [value, value, category]).fetchone()
        assert low - error <= share <= high + error


def audited_rates(frame, duck):
    seen = duck.execute(f"SELECT count(*) FROM ({SQL['p6_found']})").fetchone()[0]
    assert sorted(frame.bits) == [8, 20] and set(frame.seen) == {seen}
    assert all(a <= b for a, b in zip(frame.audited_rate, frame.rate_bound)) and (frame.positives >= frame.seen).all()


def ids_of_the_library(frame, duck):
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    own.encode_special_tokens = True
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    assert len(frame) == len(texts)
    for doc, ids in zip(frame.doc_id, frame.ids):
        assert list(ids) == (own.encode(texts[doc], add_special_tokens=False).ids if texts[doc] else [])


def whole_passages(frame, duck):
    """p9: pages whose lines, joined, hold twenty words of a passage as they are must be found."""
    found = set(zip(frame.doc_id, frame.item_id))
    pages = [(i, " ".join(t.lower().replace("-\n", "").split())) for i, t in duck.execute("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall()]
    for item, passage in duck.execute("SELECT item_id, passage FROM eval_items").fetchall():
        words = passage.lower().split()
        parts = [" ".join(words[i : i + 20]) for i in range(len(words) - 19)]
        assert not [i for i, page in pages if (i, item) not in found and any(part in page for part in parts)]


def restored_texts(frame, duck):
    """p10: no text that is restored has a sequence left that only wrong decodings make, where nothing was lost."""
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    assert (frame.garbled_chars >= frame.lost_chars).all() and set(frame.doc_id) <= set(texts)
    changed = frame[frame.garbled_chars > frame.lost_chars]
    assert len(changed) and all(texts[i] != r for i, r in zip(changed.doc_id, changed.restored))
    kept = frame[frame.garbled_chars == frame.lost_chars]
    assert all(texts[i] == r for i, r in zip(kept.doc_id, kept.restored))


def sure_pages(frame, duck):
    """p10: pages with a replacement character, or with the commonest wrong reading of a letter, are found."""
    sure = duck.execute("SELECT doc_id FROM documents WHERE contains(text, chr(65533)) OR contains(text, 'Ã¤') OR contains(text, 'Ã©')").fetchall()
    assert {i for (i,) in sure} <= set(frame.doc_id)


TRUTH = {
    "p1_distinct_orders": stated_errors, "p1_batches_merged": merged_batches, "p3_percentiles": percentile_ranks, "p3_whole_table": percentile_ranks, "p6_rates": audited_rates, "p8_ids": ids_of_the_library, "p9_found": whole_passages,
    "p10_found": sure_pages, "p10_restored": restored_texts,
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    got = QUERIES[name](spark, sf_dir)
    assert got.columns == COLUMNS.get(name, got.columns)
    frame = got.toPandas()
    if name in SQL:
        assert rows_of(frame) == rows_of(duck.execute(SQL[name]).df())
    else:
        TRUTH[name](frame, duck)
