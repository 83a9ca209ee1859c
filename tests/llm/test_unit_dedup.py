import random

from tickforge.llm import unit_dedup
from texts import prose, sentence


RUN, LINE = 12, 1


def run(spark, rows, schema="doc_id long, text string", run_words=RUN, line_words=LINE):
    return unit_dedup.dedup(spark.createDataFrame(rows, schema).repartition(4), run_words, line_words).collect()


def brute_units(text):
    """(words in lower case, line, starts) by a plain scan."""
    units, line, at, sentence_end, fresh = [], 0, 0, True, True
    for n, row in enumerate(text.split("\n")):
        for k, w in enumerate(row.split(" ")):
            if not w:
                continue
            first = not any(u[1] == n for u in units)
            if first or (units and units[-1][0][-1][-1] in ".!?") or w[0].isupper():
                units.append([[], n])
            units[-1][0].append(w.lower())
    return [(tuple(u), n) for u, n in units]


def brute(rows):
    """Which words stay, by doc_id, from plain dictionaries."""
    seen, out = {}, {}
    for doc, text in sorted(rows):
        units = brute_units(text)
        again = []
        for k, (u, _) in enumerate(units):
            again.append(u in seen)
            seen.setdefault(u, (doc, k))
        drop = set()
        i = 0
        while i < len(units):
            j = i
            while j < len(units) and again[j]:
                j += 1
            if sum(len(u) for u, _ in units[i:j]) >= RUN:
                drop |= set(range(i, j))
            i = max(j, i + 1)
        for n in {n for _, n in units}:
            own = [k for k, (_, m) in enumerate(units) if m == n]
            if all(again[k] for k in own) and sum(len(units[k][0]) for k in own) >= LINE:
                drop |= set(own)
        out[doc] = [w for k, (u, _) in enumerate(units) if k not in drop for w in u]
    return out


def test_as_brute_force(spark):
    r = random.Random(4)
    passage, line = prose(r, 70), sentence(r, 9)
    rows = []
    for doc in r.sample(range(1000), 60):
        parts = [prose(r, r.randint(5, 60)) for _ in range(3)]
        if doc % 3 == 0:
            parts.insert(1, passage)
        if doc % 4 == 0:
            parts.insert(0, line + "\n")
        rows.append((doc, " ".join(parts).replace("\n ", "\n")))
    rows += [(2000 + i, rows[i][1]) for i in range(5)]
    want, given = brute(rows), dict(rows)
    for g in run(spark, rows):
        assert [w.lower() for w in g.text.split()] == want[g.doc_id]
        kept, at = [], 0
        for s, e in g.removed:
            kept.append(given[g.doc_id][at:s])
            at = e
        assert "".join([*kept, given[g.doc_id][at:]]) == g.text


def test_passage_inside_a_line_goes_from_later_documents(spark):
    r = random.Random(8)
    passage = prose(r, 60)
    one, two = prose(r, 50).rstrip("."), prose(r, 50).rstrip(".")
    clean = prose(r, 300)
    got = {g.doc_id: g for g in run(spark, [(9, f"{one} été {passage} und {two}"), (4, f"{prose(r, 30)} {passage}"), (1, clean)])}
    assert got[1].text == clean and not got[1].removed
    assert passage in got[4].text and not got[4].removed
    assert passage not in got[9].text and len(got[9].text) < len(one) + len(two) + 20
    (s, e), text = got[9].removed[0], f"{one} été {passage} und {two}"
    assert text[s:e].strip() == passage


def test_odd_rows(spark):
    long = "same words in this one line here"
    rows = [(None, long, "n", None), (2, long, "a", None), (2, long, "b", None), (3, long + "\n" + long, "c", None), (4, None, None, None), (5, "", "e", None), (6, "é\n" + long + "\nü", "f", None)]
    got = {(g.doc_id, g.digest): g for g in run(spark, rows, "doc_id long, text string, digest string, removed string")}
    assert got[None, "n"].text == long
    assert got[2, "a"].text == got[2, "b"].text == long
    assert got[3, "c"].text == "" and got[4, None].text is None and got[4, None].removed is None
    assert got[5, "e"].text == "" and got[6, "f"].text == "é\nü"
    assert [tuple(x) for x in got[6, "f"].removed] == [(2, 2 + len(long) + 1)]
    assert unit_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_units_that_never_stood_together_stay(spark):
    names = "Anna Berta Carla Dora Emma Frida Gerda Hanna Irma Jana Karla Lena Mona Nora".split()
    chain = " ".join(names)
    pairs = [(k, f"{a} und {b} gehen") for k, (a, b) in enumerate(zip(names, names[::-1], strict=True))]
    singles = [(100 + k, n) for k, n in enumerate(names)]
    short = ["We met today.", "It rained there.", "All went home.", "Nobody saw it.", "Dogs ran off."]
    lines = [(200 + k, x) for k, x in enumerate(short)]
    rows = [*pairs, *singles, *lines, (500, chain), (501, " ".join(short)), (502, "Then " + chain.upper()), (503, " ".join(names[7:] + names[:7]))]
    got = {g.doc_id: g for g in run(spark, rows)}
    assert got[500].text == chain and got[501].text == " ".join(short)
    assert got[502].text == "Then " and got[503].text == rows[-1][1]


def test_a_run_goes_whole_and_its_first_occurrence_stays(spark):
    r = random.Random(3)
    passage = " ".join(sentence(r, n) for n in (8, 8, 3))
    again = " ".join(["Buy"] * 30)
    rows = [(1, f"{sentence(r, 5)} {passage} {sentence(r, 5)}"), (2, f"Left one. {passage} Right one."), (3, again), (4, "Other text.\n" + sentence(r, 20)), (4, passage)]
    got = [(g.doc_id, g.text) for g in run(spark, rows)]
    assert (2, "Left one. Right one.") in got and rows[0] in got and (4, "") in got
    assert (3, " ".join(["Buy"] * 12) + " ") in got and rows[3] in got


def test_repeated_short_lines_go(spark):
    rows = [(1, "Read more\nOne two three."), (2, "Any words.\nread  more\nFour five. Read more"), (3, "All rights\nreserved")]
    got = {g.doc_id: g for g in run(spark, rows)}
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1]
    assert got[2].text == "Any words.\nFour five. Read more"


def test_passages_of_any_script_inside_a_line(spark):
    r = random.Random(6)
    scripts = ["abcdefgh", "абвгдежз", "αβγδεζηθ", "ابتثجحخد"]
    rows, passages = [], {}
    for k, letters in enumerate([*scripts, "日月火水木金土山川田"]):
        def some(n, letters=letters, space="" if k == 4 else " "):
            return space.join("".join(r.choices(letters, k=1 if k == 4 else 6)) for _ in range(n))

        gap = "" if k == 4 else " "
        passages[k] = some(80)
        rows += [(10 * k, gap.join([some(30), passages[k], some(30)])), (10 * k + 1, gap.join([some(30), passages[k], some(30)]))]
    rows += [(90, "Он сказал: «да.» Потом ушёл. " + passages[1]), (91, "«" + passages[0] + ".» " + passages[3])]
    texts = dict(rows)
    got = {g.doc_id: g for g in run(spark, rows)}
    for k, passage in passages.items():
        assert got[10 * k].text == texts[10 * k]
        (cut,) = got[10 * k + 1].removed
        gone = texts[10 * k + 1][cut.start : cut.end].strip()
        assert gone in passage and len(gone) > 0.5 * len(passage)


def test_lines_alone_as_sql(spark):
    """Whole lines of any length: the first by (doc_id, place) stays, as DuckDB says."""
    import duckdb
    import pandas as pd

    r = random.Random(12)
    pool = [sentence(r, r.randint(1, 30)) for _ in range(40)]
    rows = [(k, "\n".join(r.choice(pool) if r.random() < 0.5 else f"{prose(r, 9)}".replace("\n", " ") for _ in range(r.randint(1, 8)))) for k in range(60)]
    docs = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    kept = duckdb.sql("""
        WITH l AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM docs)),
        k AS (SELECT *, row_number() OVER (PARTITION BY lower(line) ORDER BY doc_id, i) AS n FROM l)
        SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (n = 1), '') AS text FROM k GROUP BY doc_id""").fetchall()
    got = {g.doc_id: g.text for g in run(spark, rows, run_words=None)}
    assert {d: t.split("\n") for d, t in kept} == {d: t.strip("\n").split("\n") for d, t in got.items()}


def test_long_passages_go_and_short_repeats_stay(spark):
    """With the production parameters: passages of over 50 words are caught, a shared sentence is none."""
    r = random.Random(21)
    passages, common = [prose(r, 55).replace("\n", " ") for _ in range(8)], sentence(r, 11)
    rows, clean = [], []
    for k in range(120):
        own = [prose(r, r.randint(30, 90)) for _ in range(3)]
        if k % 3 == 0:
            own.insert(r.randint(0, 3), passages[k % 8])
        else:
            own.insert(1, common + "\n" * (k % 2))
            clean.append(k)
        rows.append((k, " ".join(own)))
    got = {g.doc_id: g for g in run(spark, rows, run_words=unit_dedup.RUN_WORDS, line_words=unit_dedup.LINE_WORDS)}
    assert all(got[k].text == rows[k][1] for k in clean)
    first = {}
    for k in range(0, 120, 3):
        if k % 8 in first:
            assert len(set(passages[k % 8].split()) & set(got[k].text.split())) < 0.5 * len(set(passages[k % 8].split())) and got[k].removed
        else:
            first[k % 8] = k
            assert got[k].text == rows[k][1]
