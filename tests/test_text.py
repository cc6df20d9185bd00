"""Text functions, segmentation and sources on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions.stemmer import stem
from docloom.operators import segment as S


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<array<string>>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("r")).first().r


def test_stemmer():
    cases = {"running": "run", "policies": "polici", "controls": "control", "authentication": "authent", "generously": "generous", "happily": "happili", "skies": "sky", "sized": "size", "hopping": "hop", "national": "nation", "by": "by", "dying": "die", "ties": "tie", "cries": "cri"}
    assert {w: stem(w) for w in cases} == cases


def test_lines_and_signatures(spark):
    t = "a\r\nb c\n\nd"
    assert one(spark, X.lines(F.col("t")), t=t) == ["a", "b c", "", "d"]
    assert "".join(one(spark, X.lines_keeping_ends(F.col("t")), t=t + "\n")) == t + "\n"
    assert one(spark, X.line_signature(F.col("t")), t="  Page  12 of 340 ") == "Page # of #"
    assert one(spark, X.split_after(F.col("t"), ". "), t="a. b. ") == ["a. ", "b. ", ""]


def test_normalize_and_scalars(spark):
    assert one(spark, X.normalize_page(F.col("t")), t=" ﬁ­x  y \n\n\n\nz ") == "fix y\n\nz"
    assert one(spark, X.join_broken_words(F.col("t")), t="high- level  text") == "high-level text"
    assert one(spark, X.is_refusal(F.col("t")), t=f" {X.REFUSAL.upper()}.. ") is True
    assert one(spark, X.title_of(F.col("t")), t="x" * 80) == "x" * 57 + "..."
    assert one(spark, X.canonical_model(F.col("t")), t="a/b") == "a/b:latest"
    assert one(spark, X.canonical_model(F.col("t")), t="a:1/b:2") == "a:1/b:2"


def test_table(spark):
    assert one(spark, X.render_table(F.col("t")), t=[["a", None, "b"], ["c"], ["", "", ""]]) == "a | b\nc | "
    assert one(spark, X.render_table(F.col("t")), t=[["a", "b"]]) == ""


def test_headings(spark):
    cases = {
        "AC-2 ACCOUNT MANAGEMENT": (4, "AC-2 ACCOUNT MANAGEMENT", "AC-2"),
        "AC-2(3) DISABLE ACCOUNTS": (5, "AC-2(3) DISABLE ACCOUNTS", "AC-2(3)"),
        "## AC-2 ACCOUNT MANAGEMENT": (4, "AC-2 ACCOUNT MANAGEMENT", "AC-2"),
        "### (1) Automated support": (5, "(1) Automated support", None),
        "# Introduction": (6, "Introduction", None),
        "# Note:": None,
        "AC-2 ACCOUNT MANAGEMENT ..... 7": None,
        "- PR.AC-1: Identities": (5, "PR.AC-1", "PR.AC-1"),
        "PR.AC: Access": (4, "PR.AC", "PR.AC"),
        "Identity Management (PR.AA): text": (4, "PR.AA Identity Management", "PR.AA"),
        "plain text": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    found = {r.t: (tuple(r.h) if r.h else None) for r in df.select("t", S.match_heading(F.col("t")).alias("h")).collect()}
    assert found == cases


def stack_blocks(pages, headings):
    """Blocks by an explicit stack."""
    stack, out = [], []
    for page, text in pages:
        current, snapshot = [], list(stack)
        for line in text.splitlines(keepends=True):
            h = headings.get(line.strip())
            if h:
                if "".join(current).strip():
                    out.append((page, "".join(current), [x[1] for x in snapshot], next((x[2] for x in reversed(snapshot) if x[2]), None)))
                while stack and stack[-1][0] >= h[0]:
                    stack.pop()
                stack.append(h)
                current, snapshot = [line], list(stack)
            else:
                current.append(line)
        if "".join(current).strip():
            out.append((page, "".join(current), [x[1] for x in snapshot], next((x[2] for x in reversed(snapshot) if x[2]), None)))
    return out


def test_blocks_match_a_stack(spark):
    headings = {"# one": (6, "one", None), "AC-1 POLICY": (4, "AC-1 POLICY", "AC-1"), "AC-1(2) REVIEW": (5, "AC-1(2) REVIEW", "AC-1(2)"), "PR.AC: x": (4, "PR.AC", "PR.AC")}
    rng = random.Random(5)
    docs = {d: [(p, "".join(rng.choice([*headings, "text", "more", " "]) + "\n" for _ in range(rng.randint(0, 9)))) for p in range(rng.randint(1, 4))] for d in range(40)}
    pages = spark.createDataFrame([(d, p, t) for d, ps in docs.items() for p, t in ps], "doc int, page int, text string")
    rows = S.heading_blocks(pages, "doc", "page", "text").collect()
    for d, ps in docs.items():
        mine = [(r.page, r.text, [x for x in (r.h4, r.h5, r.h6) if x], r.control_id) for r in sorted((r for r in rows if r.doc == d), key=lambda r: r.block)]
        assert mine == stack_blocks(ps, headings)


def test_bare_enhancement_inherits(spark):
    pages = spark.createDataFrame([("d", 1, "AC-2 ACCOUNT MANAGEMENT\nx\n# (3) Disable\ny\n")], "doc string, page int, text string")
    rows = {r.text: r.control_id for r in S.heading_blocks(pages, "doc", "page", "text").collect()}
    assert rows == {"AC-2 ACCOUNT MANAGEMENT\nx\n": "AC-2", "# (3) Disable\ny\n": "AC-2(3)"}


def test_running_lines(spark):
    pages = [(1, p, f"Standard 800\nbody {'x' * p}\nline\nmore\nyet\nother\n{p} of 9") for p in range(1, 10)] + [(2, p, "head") for p in (1, 2)]
    df = spark.createDataFrame(pages, "doc int, page int, text string")
    found = {(r.doc, r.signature) for r in S.repeated_lines(df, "doc", "page", "text").collect()}
    assert {(1, "Standard #"), (1, "# of #")} <= found and not any(d == 2 for d, _ in found)
    text = {(r.doc, r.page): r.text for r in S.strip_repeated_lines(df, "doc", "page", "text").collect()}
    assert text[1, 3] == "body xxx" and text[2, 1] == "head"


@pytest.mark.parametrize("seed", range(30))
def test_passages(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["word ", "a. ", "\n", "\n\n", "x" * rng.randint(1, 30)]) for _ in range(rng.randint(0, 60)))
    size, overlap = rng.randint(2, 8), rng.randint(0, 1)
    found = S.overlapping(text, size, overlap)
    assert all(0 < len(p) <= 4 * size and p.strip() for p in found)
    assert "".join(S.cut_pieces(text, 4 * size)) == text
    at = 0
    for p in found:
        at = text.index(p, max(0, at - 4 * size))
    assert not text.strip() or text.rstrip().endswith(found[-1].rstrip()[-1:])


def test_passage_arguments():
    for bad in ((0, 0), (4, -1), (4, 4)):
        with pytest.raises(ValueError):
            S.overlapping("text", *bad)
    assert S.overlapping("  ", 4, 1) == []


def test_chunks(spark):
    pages = spark.createDataFrame([("d.txt", 1, "AC-1 POLICY\n" + "word " * 900), ("d.txt", 2, "short")], "doc string, page int, text string")
    rows = sorted(S.chunk_documents(pages, "doc", "page", "text").collect(), key=lambda r: int(r.id.split(":")[1]))
    assert [r.id for r in rows] == [f"d.txt:{i}" for i in range(len(rows))] and len(rows) > 3
    assert {r.section for r in rows} == {"d.txt > AC-1 POLICY"} and {r.control_id for r in rows} == {"AC-1"}
    assert rows[-1].text == "short" and rows[-1].page == 2
