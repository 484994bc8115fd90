import random

from sizewise.llm.line_dedup import dedup_lines


def brute(rows):
    first, marked = {}, {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = text.split("\n") if text is not None else []
        for k in range(len(lines) - 2):
            w = tuple(lines[k:k + 3])
            if first.setdefault(w, (i, k)) != (i, k):
                marked.setdefault(i, set()).update((k, k + 1, k + 2))
    out = []
    for i, text in rows:
        lines = text.split("\n") if text is not None else []
        kept = [x for k, x in enumerate(lines) if k not in marked.get(i, ())]
        out.append((i, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice("abcdef") for _ in range(rng.randint(1, 12)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "\n\n\n\n"), (203, "x\ny"), (204, "a\n" * 2000), (None, "a\nb\nc\nd")]
    got = dedup_lines(spark.createDataFrame(rows, "log_id long, message string")).collect()
    assert sorted(((r.log_id, r.message, r.n_lines, r.n_removed) for r in got), key=repr) == brute(rows)


def test_repeated_rows_clashing_columns_and_empty_table(spark):
    text = "one\ntwo\nthree"
    rows = [(1, text, 7, "p"), (1, text, 7, "p"), (2, text, 8, "q")]
    docs = spark.createDataFrame(rows, "log_id long, message string, n_lines int, first string")
    got = dedup_lines(docs)
    assert got.columns == ["log_id", "message", "first", "n_lines", "n_removed"]
    assert sorted((r.log_id, r.message, r.n_removed) for r in got.collect()) == [(1, text, 0), (1, text, 0), (2, "", 3)]
    assert dedup_lines(docs.limit(0)).count() == 0
