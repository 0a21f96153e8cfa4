from __future__ import annotations

import difflib
import random
import re

from trialweave.llm import line_dedup as ld


def test_patience_takes_unique_lines_first():
    a = list(enumerate([1, 9, 2, 9, 3]))
    b = list(enumerate([9, 1, 2, 9, 4, 3]))
    assert ld.patience(a, b) == [(0, 1), (2, 2), (3, 3), (4, 5)]
    assert ld.patience(a, a) == [(i, i) for i in range(5)]
    assert ld.patience(a, []) == []


def test_patience_is_a_common_subsequence_and_finds_blocks():
    draw = random.Random(1)
    for _ in range(200):
        a = list(enumerate(draw.choices(range(12), k=draw.randrange(15))))
        b = list(enumerate(draw.choices(range(12), k=draw.randrange(15))))
        out = ld.patience(a, b)
        assert all(a[i][1] == b[j][1] for i, j in out)
        assert all(x < y and p < q for (x, p), (y, q) in zip(out, out[1:]))
    a = list(enumerate(range(30)))
    b = a[:10] + [(10, 99)] + [(i + 1, h) for i, h in a[10:]]
    assert len(ld.patience(a, b)) == sum(m.size for m in difflib.SequenceMatcher(None, [h for _, h in a], [h for _, h in b]).get_matching_blocks())


def out(spark, rows, **more):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.text, r.deleted_lines) for r in ld.dedup_lines(frame, **more).collect()), key=str)


def test_the_later_document_loses_the_block(spark):
    block = "this line is shared by all\nand so is this second line"
    rows = [(1, f"own first line of one\n{block}\nyes"), (2, f"{block}\nown line of two is here\n\nyes"), (3, f"THIS line  is shared by all\nsomething in between them\n{block.split(chr(10))[1]}")]
    assert out(spark, rows) == [(1, rows[0][1], 0), (2, "own line of two is here\n\nyes", 2), (3, "something in between them", 2)]


def test_short_blocks_stay_and_copies_are_emptied(spark):
    rows = [(5, "yes\nno"), (6, "yes\nno\nmaybe"), (7, "one two three four five"), (8, "one two three four five"), (9, "one two three four five")]
    assert out(spark, rows) == [(5, "yes\nno", 0), (6, "yes\nno\nmaybe", 0), (7, "one two three four five", 0), (8, "", 1), (9, "", 1)]
    assert out(spark, rows[:2], least_words=2)[1] == (6, "maybe", 2)


def test_crossing_blocks_keep_one(spark):
    x, y = "alpha beta gamma delta epsilon", "zeta eta theta iota kappa"
    assert out(spark, [(1, f"{x}\n{y}"), (2, f"{y}\n{x}")])[1][2] == 1


def test_edges_keep_rows_and_columns(spark, edges, nothing):
    result = ld.dedup_lines(edges.selectExpr("*", "1 AS later", "2 AS gone", "3 AS deleted_lines"))
    assert result.columns == [*edges.columns, "later", "gone", "deleted_lines"]
    rows = result.collect()
    assert len(rows) == edges.count()
    texts = {}
    for r in rows:
        texts.setdefault(r.doc_id, set()).add(r.text)
    assert texts[2] == {""} and texts[3] == {None} and texts[4] == {""} and texts[None] == {None, "A row without an id has five words and more."}
    assert ld.dedup_lines(nothing).count() == 0


def test_against_a_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.text, r.deleted_lines) for r in ld.dedup_lines(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    lines = {i: [(k, re.sub(r"\s+", " ", x).lower().strip()) for k, x in enumerate(re.split(ld.LINE_END, t)) if x.strip()] for i, t in texts.items()}
    first = {}
    for i in sorted(lines):
        for _, x in lines[i]:
            first.setdefault(x, i)
    for i, mine in lines.items():
        gone = set()
        for f in {first[x] for _, x in mine} - {i}:
            a = [(p, x) for p, (_, x) in enumerate(mine) if first[x] == f]
            b = [(p, x) for p, (_, x) in enumerate(lines[f]) if x in {x for _, x in a}]
            gone |= {mine[p][0] for p in ld._common_blocks(a, b, {p: len(x.split(" ")) for p, (_, x) in enumerate(mine)}, 5)}
        left = "\n".join(x for k, x in enumerate(re.split(ld.LINE_END, texts[i])) if k not in gone) if gone else texts[i]
        assert got[i] == ("" if left.isspace() else left, len(gone))


def test_a_copy_whose_lines_have_several_first_holders_is_emptied(spark):
    copied = "a first line that one has\nok\na second line that two has\nyes it is"
    verse = "red\nblue green\nwhite\ngrey brown"
    rows = [
        (1, "ok\na first line that one has"), (2, "yes it is\nand more of that here\na second line that two has"), (3, copied), (4, copied.upper()),
        (5, f"{copied}\none line more at the end"), (6, "red\nnone\nwhite"), (7, f"blue green\nother\n{verse}\nend of seven"), (8, f"eight\n{verse}\neight too"),
    ]
    got = dict((i, (t, n)) for i, t, n in out(spark, rows, find=ld.block_lines))
    assert got[4] == ("", 4) and got[5] == ("one line more at the end", 4) and got[8] == ("eight\neight too", 4)
    assert got[1][1] == got[2][1] == got[6][1] == got[7][1] == 0


def test_the_older_cases_hold_for_whole_documents(spark, edges, nothing):
    block = "this line is shared by all\nand so is this second line"
    rows = [(1, f"own first line of one\n{block}\nyes"), (2, f"{block}\nown line of two is here\n\nyes"), (3, "yes\nno"), (4, "yes\nno"), (5, "alpha beta gamma delta epsilon\nzeta eta theta iota kappa"), (6, "zeta eta theta iota kappa\nalpha beta gamma delta epsilon")]
    assert [n for _, _, n in out(spark, rows, find=ld.block_lines)] == [0, 2, 0, 0, 0, 1]
    result = ld.dedup_lines(edges, find=ld.block_lines)
    assert result.count() == edges.count() and {r.text for r in result.where("doc_id = 2").collect()} == {""}
    assert ld.dedup_lines(nothing, find=ld.block_lines).count() == 0


def test_blocks_against_whole_documents_aligned(spark, sf):
    """All lines of both are aligned; partners are the first holders of every run of five words and more, found by comparing texts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.text, r.deleted_lines) for r in ld.dedup_lines(docs, find=ld.block_lines).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    lines = {i: [(k, re.sub(r"\s+", " ", x).lower().strip()) for k, x in enumerate(re.split(ld.LINE_END, t)) if x.strip()] for i, t in texts.items()}
    flat = {i: "\n".join(["", *(x for _, x in of), ""]) for i, of in lines.items()}
    copies = 0
    for i, mine in lines.items():
        words = {p: len(x.split(" ")) for p, (_, x) in enumerate(mine)}
        earlier = [f for f in sorted(lines) if f < i]
        partners, gone = set(), set()
        for p in range(len(mine)):
            for q in range(p + 1, len(mine) + 1):
                if sum(words[x] for x in range(p, q)) >= 5:
                    run = "\n".join(["", *(x for _, x in mine[p:q]), ""])
                    partners |= {next((f for f in earlier if run in flat[f]), None)}
                    if q - p > 5:
                        break
        for f in partners - {None}:
            shared = {x for _, x in mine} & {x for _, x in lines[f]}
            a, b = ([(p, x) for p, (_, x) in enumerate(of) if x in shared] for of in (mine, lines[f]))
            gone |= {mine[p][0] for p in ld._common_blocks(a, b, words, 5)}
        if any(flat[f] == flat[i] for f in earlier) and sum(words.values()) >= 5:
            copies += 1
            assert got[i] == ("", len(mine))
        assert got[i][1] >= len(gone) and set(re.split(ld.LINE_END, got[i][0])) <= {*(x for k, x in enumerate(re.split(ld.LINE_END, texts[i])) if k not in gone), ""}
    assert copies == 10


def test_a_block_that_crosses_in_the_first_holders_is_found_in_a_later_one(spark):
    """The last document's second block stands behind the first one in no early holder; a later holder has it alone."""
    x = [f"first block line {k} of five words" for k in range(3)]
    y = "the other block has one line"
    crossing = [(i, "\n".join([y, f"own line number {i}", *x, f"end of number {i}"])) for i in range(1, 41)]
    rows = [*crossing, (50, f"a text before\n{y}\nan end of its own"), (60, "\n".join(["start of the last", *x, "a middle line", y, "end of the last"]))]
    got = {i: (t, n) for i, t, n in out(spark, rows, find=ld.block_lines)}
    assert got[60] == ("start of the last\na middle line\nend of the last", 4)


def test_pairs_do_not_grow_with_the_square_of_a_runs_documents(spark, monkeypatch):
    """The second block of the last 40 documents stands behind the first one in no early holder but one, and all of them hold it."""
    x, y = "first block line of five words\nsecond block line of five words", "the other block has one line"
    rows = [(i, f"{y}\nown line number {i}\n{x}\nend of number {i}") for i in range(1, 41)] + [(50, f"a text before\n{y}\nan end of its own")]
    rows += [(i, f"start of number {i}\n{x}\nmiddle line of {i}\n{y}\nend of number {i}") for i in range(100, 140)]
    tried, cut = [], ld.cut_lineage

    def counted(df):
        out = cut(df)
        if out.columns == ["doc", "partner"]:
            tried.append(out.count())
        return out

    monkeypatch.setattr(ld, "cut_lineage", counted)
    got = {i: n for i, _, n in out(spark, rows, find=ld.block_lines)}
    assert all(got[i] == 3 for i in range(100, 140)) and got[50] == 1
    assert sum(tried) <= 6 * len(rows)


def test_holders_of_one_class_stand_for_all(spark):
    """A repeated line goes where an earlier document repeats it as well, however many hold it once."""
    line, other = "a line of just five words", "another line of some five words"
    rows = [(i, f"{line}\nown line {i}") for i in range(1, 30)] + [(40, f"{line}\nx\n{line}\ny\n{line}"), (41, f"{line}\nz\n{line}\nno"), (42, f"{other}\n{line}\n{line}\n{other}\nv"), (43, f"{other}\nw\n{line}\n{other}")]
    got = {i: n for i, _, n in out(spark, rows, find=ld.block_lines)}
    assert [got[i] for i in (1, 29, 40, 41, 42, 43)] == [0, 1, 1, 2, 2, 3]


def test_lines_to_delete_are_not_sent_to_every_task(spark):
    """Their number follows the documents, so the join has the plan of a large table on a small one as well, and sorts no text."""
    docs = spark.createDataFrame([(i, "a line of five words here\nand another of five words") for i in range(4)] + [(None, "null key")], "doc_id long, text string")
    out = ld.dedup_lines(docs, find=ld.block_lines)
    last = out._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in last and "BroadcastHashJoin" not in last and "SortMergeJoin" not in last
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == [(0, "a line of five words here\nand another of five words"), (1, ""), (2, ""), (3, ""), (None, "null key")]
