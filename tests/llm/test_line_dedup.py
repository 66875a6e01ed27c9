from plumbline.llm import line_dedup


def _brute(rows, width=3):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        lines = (text or "").split("\n")
        solid = [k for k, x in enumerate(lines) if x.strip(line_dedup.ENDS)]
        gone = set()
        for i in range(len(solid) - width + 1):
            w = tuple(lines[k].strip(line_dedup.ENDS) for k in solid[i : i + width])
            gone |= set(solid[i : i + width]) if w in seen else set()
            seen.add(w)
        out[doc_id] = "\n".join(x for k, x in enumerate(lines) if k not in gone) if text is not None else None
    return out


def test_like_brute_force(spark):
    rows = [(1, "a\nb\nc\nd\ne"), (2, "x\nb\n\n c \nd\ny"), (3, "a\nb\nc\nb\nc\nd"), (4, "q\n" * 10), (5, "a\nb"), (6, None), (7, ""), (8, "a\nb\nc\nd\ne")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _brute(rows)
    lines = {x.strip() for _, t in rows for x in (t or "").split("\n")}
    assert lines == {x.strip() for t in got.values() for x in (t or "").split("\n")}, "every line survives somewhere"


def test_edges(spark, odd_docs, no_docs):
    rows = line_dedup.dedup_lines(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r.doc_id: r.n_removed for r in rows}[8] == 3
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_clashing_and_missing_ids(spark):
    rows = [(1, "a\nb\nc"), (5, "a\nb\nc"), (5, "x\ny\nz"), (None, "p\nq\nr\ns"), (None, "a\nb\nc\nd"), (None, "p\nq\nr"), (7, "p\nq\nr"), (7, "p\nq\nr")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = sorted((r.doc_id or 0, r.text) for r in got)
    assert left == [(0, ""), (0, "d"), (0, "s"), (1, "a\nb\nc"), (5, ""), (5, "x\ny\nz"), (7, "p\nq\nr"), (7, "p\nq\nr")]
