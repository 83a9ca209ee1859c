import random

from tickforge.llm import template_leaks
from texts import prose, sentence


def run(spark, docs, items, **more):
    docs = spark.createDataFrame(docs, "item_id string, doc_id long, text string, h long").repartition(3)
    return {(r.doc_id, r.item_id): r for r in template_leaks.leaks(docs, spark.createDataFrame(items, "item_id long, text string, doc_id int"), **more).collect()}


def test_exact_leaks_as_containment(spark):
    r = random.Random(2)
    items = [(k, " ".join(sentence(r, r.randint(5, 12)) for _ in range(r.randint(1, 4))), 0) for k in range(30)]
    docs = []
    for doc in range(150):
        parts = [prose(r, r.randint(0, 80)) for _ in range(2)]
        if doc % 3 == 0:
            parts.insert(1, r.choice(items)[1])
        docs.append(("x", doc, " ".join(p for p in parts if p), 1))
    want = {(d, k) for _, d, t, _ in docs for k, x, _ in items if x in t}
    got = run(spark, docs, items)
    assert set(got) == want
    for (doc, k), g in got.items():
        text = docs[doc][2][g.start : g.end]
        assert g.exact and text in docs[doc][2] and text.split()[-1] == items[k][1].split()[-1]


ITEM = "A baker sells 12 loaves to Anna and 12 rolls to Bruno, then Anna pays 30 dollars for 5 kg of flour."


def test_reparameterised_questions_are_caught_and_frames_are_not(spark):
    same = ITEM.replace("12", "48").replace("Anna", "Clara").replace("Bruno", "Emil").replace("30 dollars", "7.50 €").replace("5 kg", "900 g")
    mixed = ITEM.replace("12 loaves", "48 loaves").replace("to Anna", "to Clara")  # 12 and Anna stand for two values each
    other = "The weather was fine and we walked to the lake with 3 friends and 4 dogs before Bruno came home late."
    got = run(spark, [("", 1, "So: " + same, 0), ("", 2, mixed, 0), ("", 3, other, 0), ("", 4, ITEM, 0)], [(7, ITEM, 0)])
    assert set(got) == {(1, 7), (4, 7)}
    assert got[4, 7].exact and not got[1, 7].exact


def test_odd_rows(spark):
    short, tiny = "only six words are in here", "too short"
    docs = [("", None, ITEM, 0), ("", 1, None, 0), ("", 2, "", 0), ("", 3, f"Well, {short} today", 0), ("", 4, tiny, 0), ("", 5, f"{ITEM} {ITEM}", 0), ("", 5, ITEM, 0), ("", 6, "12 " * 500, 0)]
    items = [(1, ITEM, 0), (1, ITEM, 0), (2, short, 0), (3, tiny, 0), (None, ITEM, 0), (4, None, 0), (5, "1 2 3 4 5 6 7 8 9", 0)]
    assert set(run(spark, docs, items)) == {(3, 2), (5, 1)}
    assert set(run(spark, docs, items, least_item=1)) == {(3, 2), (5, 1), (4, 3)}
    assert run(spark, [("", 1, ITEM, 0)], [(1, None, 0)]) == {}
    assert run(spark, [("", 1, None, 0)], [(1, ITEM, 0)]) == {}


def test_copies_without_words_or_in_other_case(spark):
    caps, sums, names = "WHAT IS THE SUM OF ALL PRIMES BELOW TEN", "12 + 30 = 42", "Anna Berta Carla Dora Emma Frida Gerda Hanna Irma"
    docs = [("", 1, f"Then {caps} came up", 0), ("", 2, caps.lower(), 0), ("", 3, f"He wrote {sums} there", 0), ("", 4, f"They were {names}.", 0), ("", 5, "Then ANOTHER LINE OF ALL CAPS WAS PUT UP HERE", 0)]
    assert set(run(spark, docs, [(1, caps, 0), (2, sums, 0), (3, names, 0)])) == {(1, 1), (2, 1), (3, 2), (4, 3)}


def test_names_of_any_length_and_units_against_numbers(spark):
    item = "A train from Paris to New York City needs 5 km of rail, 16 GB of maps and 3 days."
    same = "A train from Rio de Janeiro to Oslo needs 12km of rail, 64GB of maps and 9 days.".replace(" de ", " De ")
    got = run(spark, [("", 1, same, 0)], [(1, item, 0)])
    assert set(got) == {(1, 1)} and not got[1, 1].exact


UNITS = {"kg", "km", "days", "dollars"}


def brute_tokens(text):
    """(token, value) of ASCII text by a plain scan: names in runs, units behind numbers."""
    out, opens, number = [], True, False
    for w in text.split():
        bare = w.strip(".,:?!")
        if bare.replace(".", "").isdigit():
            out.append(("<number>", bare))
        elif number and not opens and bare.lower() in UNITS:
            out.append(("<unit>", bare.lower()))
        elif bare[:1].isupper() and not opens:
            if out[-1][0] == "<name>":
                out[-1] = ("<name>", f"{out[-1][1]} {bare.lower()}")
            else:
                out.append(("<name>", bare.lower()))
        else:
            out.append((None, bare.lower()))
        number, opens = out[-1][0] == "<number>", w[-1] in ".:?!"
    return out


def brute(docs, items):
    """Leaks by trying every alignment of every document with every item."""
    found = set()
    views = lambda t: (brute_tokens(t), [(None, w.strip(".,:?!").lower()) for w in t.split()])
    for _, item_id, text in items:
        for doc_id, doc in docs:
            best = (0, False)
            for kind, (x, y) in enumerate(zip(views(text), views(doc), strict=True)):
                same = lambda a, b: (a[0] or a[1]) == (b[0] or b[1])
                for shift in range(-len(x) + 1, len(y)):
                    covered, values = set(), {}
                    for i in range(len(x) - 7):
                        if 0 <= i + shift and i + shift + 8 <= len(y) and all(same(x[i + k], y[i + shift + k]) for k in range(8)) and (kind or sum(t is None for t, _ in x[i : i + 8]) >= 3):
                            covered |= set(range(i, i + 8))
                    for i in covered:
                        if x[i][0]:
                            values.setdefault(x[i][1], set()).add(y[i + shift][1])
                    if len(covered) >= 13 or covered and len(covered) >= 0.5 * len(x):
                        best = max(best, (len(covered), all(len(v) == 1 for v in values.values())))
            if best[1]:
                found.add((doc_id, item_id))
    return found


def test_templates_as_brute_force(spark):
    r = random.Random(17)
    fill = lambda: {"a": r.choice("Anna Bruno Carla Dora Emil".split()), "b": r.choice(["New York", "Paris", "San Jose Del Cabo"]), "n": r.randint(1, 9), "m": r.choice(["3.5", "12", "7"]), "u": r.choice(sorted(UNITS))}
    frames = [f"{sentence(r, 4)} The {{a}} of {{b}} {sentence(r, 3).lower()[:-1]} {{n}} {{u}} and {{n}} more for {{m}} {{u}}, {sentence(r, 3).lower()} So {{a}} {sentence(r, r.randint(2, 6)).lower()}" for _ in range(12)]
    items = [("", k, f.format(**fill())) for k, f in enumerate(frames)]
    docs = []
    for doc in range(80):
        f = r.choice(frames)
        text = f.format(**fill())
        if doc % 4 == 0:  # a slot that isn't consistent
            text = text.replace(text.split()[5], "Zoe", 1)
        if doc % 5 == 0:
            words = text.split()
            words[r.randrange(len(words))] = "other"
            text = " ".join(words)
        docs.append((doc, " ".join([prose(r, r.randint(0, 30)), text, prose(r, 9)]).strip()))
    want = brute(docs, items)
    assert 20 < len(want) < 200
    assert set(run(spark, [("", d, t, 0) for d, t in docs], [(k, t, 0) for _, k, t in items])) == want
