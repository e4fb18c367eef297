from ferrule.llm import decontam


def brute(text, items, n=10):
    w, hit, named = decontam.normalised(text), set(), set()
    for item, t in items:
        b = decontam.normalised(t)
        for win in ([b[i : i + n] for i in range(len(b) - n + 1)] if len(b) >= n else [b] if b else []):
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    named |= {str(item)} - {"None"}
    return len(w), len(hit), sorted(named)


def result(df):
    return sorted((str(r.doc_id), r.bench_words, sum(b - a for a, b in r.bench_hits), r.bench_items) for r in df.collect())


def test_brute_force_in_one_pass_and_in_blocks(spark, odd):
    rows = odd.collect()
    texts = [r.text for r in rows if r.text]
    items = [(1, " ".join(texts[0].split()[3:20])), (2, "mit LICENSE"), (3, None), (4, "..."), (None, "1234-5678"), (2, "word"), (10, texts[0]), (10, texts[0])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(r.doc_id), *brute(r.text, items)) for r in rows)
    assert result(decontam.decontaminate(odd, bench)) == want
    assert result(decontam.decontaminate(odd, bench, block_windows=9)) == want


def test_blocks_keep_columns_of_any_name(spark, clashing):
    bench = spark.createDataFrame([(1, "mit license"), (2, "word"), (3, "a b c")], "item_id long, text string")
    mine = clashing.withColumns({"bench_source": clashing.source, "h1": clashing.text, "row": clashing.lang})
    one, many = decontam.decontaminate(mine, bench), decontam.decontaminate(mine, bench, block_windows=1)
    assert one.columns == many.columns and result(one) == result(many)
    assert decontam.remove_spans(many).columns == [c for c in mine.columns if c != "bench_hits"] and decontam.remove_documents(many).count() == clashing.count() - 3


def test_removal(spark, clashing, nothing):
    bench = spark.createDataFrame([(1, "mit license")], "item_id long, text string")
    marked = decontam.decontaminate(clashing, bench)
    assert set(marked.columns) == set(clashing.columns) | {"bench_words", "bench_items"}
    assert decontam.remove_documents(marked).count() == clashing.count() - 1
    cut = {r.doc_id: r.text for r in decontam.remove_spans(marked).collect()}
    own = {r.doc_id: r.text for r in clashing.collect()}
    assert cut[14] == own[14].replace("MIT License", "") and all(cut[i] == own[i] for i in own if i != 14)
    assert decontam.decontaminate(nothing, bench).count() == 0
    assert decontam.decontaminate(clashing, spark.createDataFrame([], "item_id long, text string")).filter("size(bench_hits) > 0").count() == 0
