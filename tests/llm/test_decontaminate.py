from __future__ import annotations

import re
from itertools import product

from tests.llm.frames import LONG, PROSE, doc, empty, frame, messy
from tillroll.llm import decontaminate
from tillroll.llm.queries import QUERIES

QUESTION = (
    "Yesterday morning Alice bought 12 apples for 3 dollars at the market and then gave 5 of the apples "
    "to Robert before she walked 2 km back home with Alice's dog."
)
CHANGED = (
    "Yesterday morning Sophie bought 40 apples for 9 euros at the market and then gave 17 of the apples "
    "to Hassan before she walked 8 miles back home with Sophie's dog."
)
# Two numbers of the item have become one here.
TWISTED = QUESTION.replace("12 apples", "7 apples").replace("gave 5", "gave 7")
SHORT = "Which planet is closest to the sun"
FILL = "Some clean words come before the passage and say nothing of note here. "


def benchmark(spark, texts):
    return spark.createDataFrame([(k, t, "mine", "mine") for k, t in enumerate(texts)], "item_id bigint, text string, hash string, n string")


def found(docs, items):
    return {(r["_id"], r["item_id"]): r for r in decontaminate.leaks(docs, items).collect()}


def test_passages_in_many_shapes(spark):
    shapes = [
        QUESTION,
        FILL + QUESTION + " " + FILL,
        FILL + QUESTION.lower(),
        FILL + QUESTION.upper(),
        FILL + CHANGED,
        FILL + "  \n".join(QUESTION.replace(",", "").split(" ")),
        FILL + " *** ".join(QUESTION.split(" ")),
        FILL + SHORT + "?",
        FILL + TWISTED,
        FILL + " ".join(QUESTION.split()[:8]),
        FILL + PROSE,
        FILL + " ".join(sorted(QUESTION.split())),
        LONG + " " + QUESTION + " " + LONG,
        QUESTION + " " + FILL + CHANGED,
    ]
    docs = frame(spark, [doc(k, t) for k, t in enumerate(shapes)])
    got = found(docs, benchmark(spark, [QUESTION, SHORT, "too short", None]))
    assert set(got) == {(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (6, 0), (7, 1), (12, 0), (13, 0)}
    assert got[1, 0]["changed_slots"] == 0 and got[13, 0]["changed_slots"] == 0
    assert got[4, 0]["changed_slots"] == 7  # three names, two numbers, two quantities
    kept = decontaminate.drop_leaks(docs, benchmark(spark, [QUESTION, SHORT])).collect()
    assert sorted(r["doc_id"] for r in kept) == [8, 9, 10, 11] and kept[0]["a.b"] == "mine 11"


def test_messy_rows(spark):
    docs = messy(spark)
    got = found(docs, benchmark(spark, [PROSE, PROSE, ""]))
    assert set(got) == {(1, 0), (1, 1), (2, 0), (2, 1)}
    kept = decontaminate.drop_leaks(docs, benchmark(spark, [PROSE])).collect()
    assert len(kept) == docs.count() - 2
    null_id = frame(spark, [doc(None, PROSE), doc(None, "clean"), doc(5, PROSE), doc(5, "clean")])
    assert [r["text"] for r in decontaminate.drop_leaks(null_id, benchmark(spark, [PROSE])).collect()] == ["clean", "clean"]


def test_empty_tables(spark):
    assert found(empty(spark), benchmark(spark, [QUESTION])) == {}
    assert found(messy(spark), benchmark(spark, [])) == {}
    assert len(decontaminate.drop_leaks(messy(spark), benchmark(spark, [])).collect()) == messy(spark).count()


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    docs = frame(spark, [doc(0, FILL + CHANGED), doc(1, FILL + PROSE), doc(2, FILL)])
    items = benchmark(spark, [QUESTION, PROSE])
    expected = set(found(docs, items))
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 64)
    assert set(found(docs, items)) == expected == {(0, 0), (1, 1)}


def plain(text):
    return [core.lower() for core in map(decontaminate.core_of, (text or "").split()) if core]


def test_query_finds_every_literal_passage(spark):
    sf_dir = "/root/testdata/sf0.01"
    items = {r["item_id"]: " ".join(plain(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    held = set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        text = f" {' '.join(plain(r['text']))} "
        held |= {(r["doc_id"], k) for k, item in items.items() if f" {item} " in text}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op9_decontaminate"](spark, sf_dir).collect()}
    assert got == held and len(held) > 20


def test_tokens_by_hand():
    words = decontaminate.Words()
    one = b"On Monday Ann Lee ran 5 km. Then Bob ate 3kg of pie; he paid twenty five 7"
    other = b"On Friday Eve ran 9 miles. Then Tom Dean ate 4 lb of pie; he paid 1 2"
    t = decontaminate.Template([one, other], words)
    literal, filled, template = t.forms()
    assert len(literal.hashes) == len(one.split()) + len(other.split())
    first = [t.slots(template, k, 1) for k in range(len(template.hashes)) if template.slot[k] and template.text[k] == 0]
    assert sum(first, []) == [
        "<name>monday ann lee", "<quantity>5 km", "<name>bob", "<quantity>3kg", "<number>twenty five", "<number>7",
    ]
    n = int((template.text == 0).sum())
    assert (template.hashes[:n] == template.hashes[n:]).all()
    windows, counts = template.windows(6)
    assert not counts[n - 5 : n].any()  # never across texts
    assert len(filled.hashes) > len(template.hashes)


def test_values_of_other_lengths_and_inserted_words(spark):
    item = "Every second summer the old painter from Boston sold exactly 25 small pictures to visitors"
    longer = "The committee of the town wants to know how often the bus from Salem stops for 3 km on its way"
    shapes = [
        item.replace("Boston", "Denver"),
        item.replace("Boston", "New York City"),
        item.replace("25", "twenty five"),
        item.replace("sold exactly", "sold then exactly"),
        item.replace("Boston sold", "Boston he often sold"),
        longer.replace("3 km", "12 miles"),
        longer.replace("3 km", "12miles").replace("Salem", "Port Of Spain"),
        longer.replace("3 km", "40"),
        " ".join(item.split()[:7]),
    ]
    docs = frame(spark, [doc(k, f"{FILL}{t}. {FILL}") for k, t in enumerate(shapes)])
    got = found(docs, benchmark(spark, [item, longer]))
    assert set(got) == {(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (5, 1), (6, 1), (7, 1)}
    assert got[1, 0]["changed_slots"] == 1 and got[6, 1]["changed_slots"] == 2


def test_short_items_are_found_as_whole_sentences(spark):
    items = ["Who wrote Dune Messiah", "Name 3 planets.", "Why?"]
    shapes = [
        items[0],
        f"{FILL}Who wrote Dune Messiah? {FILL}",
        f"{FILL}Nobody asked who wrote Dune Messiah before. {FILL}",
        f"{FILL}name 3 planets! {FILL}",
        f"{FILL}Name 4 planets. {FILL}",
        "Why! Because.",
        "That is why",
    ]
    got = found(frame(spark, [doc(k, t) for k, t in enumerate(shapes)]), benchmark(spark, items))
    assert set(got) == {(0, 0), (1, 0), (3, 1), (5, 2)}


def test_tiles_make_no_difference(spark, monkeypatch):
    texts = [QUESTION, CHANGED, "", PROSE, None, FILL + SHORT, "x" * 5000, SHORT] * 3
    docs = frame(spark, [doc(k, t) for k, t in enumerate(texts)])
    items = benchmark(spark, [QUESTION, SHORT, PROSE])
    expected = set(found(docs, items))
    monkeypatch.setattr(decontaminate, "TILE_BYTES", 40)
    assert set(found(docs, items)) == expected and len(expected) == 15


def test_memory_of_words_is_bounded_by_bytes():
    words = decontaminate.Words()
    decontaminate.Template([("漢" * 1000 + str(k)).encode() for k in range(200)] + [b"a b c"], words)
    assert set(words) == {b"a", b"b", b"c"}


def test_items_made_of_figures(spark):
    items = [
        "Sort 7 3 9 1 4 8 in ascending order",
        "2 4 8 16 32 64 128 256 512",
        "Year 1990 12 km 1991 15 km 1992 19 km 1993 25 km 1994 31 km",
    ]
    docs = frame(spark, [doc(k, f"{FILL}{t} {FILL}") for k, t in enumerate([*items, items[0].replace("3 9", "9 3")])])
    assert set(found(docs, benchmark(spark, items))) == {(0, 0), (1, 1), (2, 2)}


def plain_forms(text):
    """(key, slot value, first, end) of the tokens of each form, by the rules of the docstring."""
    words, ended = [], True
    for word in (text or "").split():
        core = re.sub(r"^[\W_]+|[\W_]+$", "", word)
        if core:
            lower = core.lower()
            attached = re.fullmatch(r"[+-]?\d[\d.,]*([^\W\d_]+|%|°[cf])", lower)
            if lower in decontaminate.NUMBER_WORDS:
                kind = "number word"
            elif re.fullmatch(r"[+-]?\d[\d.,:/]*", core):
                kind = "number"
            elif attached and attached[1] in decontaminate.UNITS:
                kind = "quantity"
            elif lower in decontaminate.UNITS:
                kind = "unit"
            else:
                kind = "name" if len(core) > 1 and core[0].isupper() and not core.isupper() and not ended else ""
            words.append((lower, kind))
            ended = False
        ended |= word.rstrip("\"')]}»”’")[-1:] in tuple(".!?:")
    forms = [[(w, None, k, k + 1) for k, (w, _) in enumerate(words)]]
    for with_names in (False, True):
        tokens = []
        for k, (word, kind) in enumerate(words):
            before = words[k - 1][1] if k else ""
            numeric = before in ("number", "number word")
            if kind == "unit" and numeric:
                _, value, first, _ = tokens[-1]
                tokens[-1] = ("<quantity>", f"{value} {word}", first, k + 1)
            elif (kind == "number word" and numeric) or (with_names and kind == before == "name"):
                key, value, first, _ = tokens[-1]
                tokens[-1] = (key, f"{value} {word}", first, k + 1)
            elif kind in ("number", "number word", "quantity"):
                tokens.append(("<quantity>" if kind == "quantity" else "<number>", word, k, k + 1))
            elif with_names and kind == "name":
                tokens.append(("<name>", word, k, k + 1))
            else:
                tokens.append((word, None, k, k + 1))
        forms.append(tokens)
    return forms


def plain_leak(text, item):
    """(covered words, changed slots) of the best occurrence of ``item`` in ``text``, or None; every pair of windows."""
    item_forms, matches = plain_forms(item), []
    size = len(item_forms[0])
    for theirs, ours in product(item_forms, plain_forms(text)):
        n = min(decontaminate.WINDOW_WORDS, len(theirs))
        if n < decontaminate.LEAST_WORDS:
            continue
        for i, j in product(range(len(theirs) - n + 1), range(len(ours) - n + 1)):
            a, b = theirs[i : i + n], ours[j : j + n]
            if [t[0] for t in a] != [t[0] for t in b] or sum(t[1] is None for t in a) < n * decontaminate.LEAST_LITERAL:
                continue
            pairs = {((x[0], x[1]), (y[0], y[1])) for x, y in zip(a, b) if x[1] is not None}
            matches.append((b[0][2] - a[0][2], a[0][2], a[-1][3], pairs))
    groups, offsets = [], sorted({m[0] for m in matches})
    near = [[]]
    for offset in offsets:
        groups.append({offset})
        if near[-1] and offset - near[-1][-1] > decontaminate.MOST_SHIFT:
            near.append([])
        near[-1].append(offset)
    found = []
    for group in [*groups, *near]:
        own = [m for m in matches if m[0] in group]
        covered = len({k for _, first, end, _ in own for k in range(first, end)})
        pairs = set().union(*[m[3] for m in own]) if own else set()
        one_to_one = len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})
        if one_to_one and own and (covered >= decontaminate.RUN_WORDS or covered >= decontaminate.ITEM_SHARE * size):
            found.append((covered, -sum(a != b for a, b in pairs)))
    return (max(found)[0], -max(found)[1]) if found else None


def test_templates_against_every_pair_of_windows(spark):
    items = [
        QUESTION,
        "How far did Alice Brown walk from Boston to Salem if she walked twenty five miles a day for 3 days",
        "A train leaves Paris at 9:30 and needs 4 hours for 320 km how fast is it on average",
        "Sort 7 3 9 1 4 8 in ascending order",
        "Name the longest river that flows through Old Saxon Town and the lake at its end",
    ]
    swaps = [
        {}, {"Alice": "Maria Lopez"}, {"Alice Brown": "Tom", "Boston": "New York"}, {"12": "40", "3": "17"},
        {"twenty five miles": "7km"}, {"walked": "slowly walked"}, {"5": "12"}, {"Paris": "Rome", "320 km": "90 miles"},
        {"apples": "pears"}, {"9": "two hundred"}, {"river": "great river", "Old Saxon Town": "Rome"},
    ]
    texts = [""]
    for item, swap in product(items, swaps):
        for old, new in swap.items():
            item = re.sub(rf"\b{old}\b", new, item)
        texts += [FILL + item + " " + FILL, " ".join(item.split()[:14]) + "."]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()[:30]]
    docs = frame(spark, [doc(k, t) for k, t in enumerate(texts)])
    got = {pair: (r["covered_words"], r["changed_slots"]) for pair, r in found(docs, benchmark(spark, items)).items()}
    expected = {(j, k): plain_leak(t, item) for j, t in enumerate(texts) for k, item in enumerate(items)}
    expected = {pair: leak for pair, leak in expected.items() if leak}
    assert len(expected) > 80 and any(changed for _, changed in expected.values())
    assert got == expected


def test_a_shared_opening_is_compared_once(spark):
    opening = "Read the following short passage with care and answer the question"
    items = [f"{opening} {' '.join(f'item{k}word{j}' for j in range(20))}" for k in range(25)]
    counts = {}
    for size in (40, 160):
        texts = [f"{' '.join(f'own{k}x{j}' for j in range(5 + k % 7))} {opening} {' '.join(f'text{k}y{j}' for j in range(20))}" for k in range(size)]
        met, members, _ = decontaminate._matches(frame(spark, [doc(k, t) for k, t in enumerate(texts)]), benchmark(spark, items))
        assert members.count() == size and members.select("class").distinct().count() == 1
        counts[size] = met.count()
    windows = len(opening.split()) - decontaminate.WINDOW_WORDS + 1
    assert counts[40] == counts[160] == windows * len(items)
    # Documents that share the opening and go on like an item are still found, each with its own item.
    texts += [f"own words {items[3]}", items[7], f"{items[3]} {items[7]}"]
    docs = frame(spark, [doc(k, t) for k, t in enumerate(texts)])
    assert set(found(docs, benchmark(spark, items))) == {(160, 3), (161, 7), (162, 3), (162, 7)}


def test_passages_far_apart_are_classes_of_their_own(spark):
    # Ends with a mark, so that what follows begins a sentence everywhere.
    gap = " ".join(f"between{k}" for k in range(200)) + "."
    texts = [f"{QUESTION} {gap} {SHORT}?", QUESTION, f"{gap} {SHORT}?", f"{gap} {QUESTION} {gap} {QUESTION}"]
    _, members, _ = decontaminate._matches(frame(spark, [doc(k, t) for k, t in enumerate(texts)]), benchmark(spark, [QUESTION, SHORT]))
    by_class = {}
    for r in members.collect():
        by_class.setdefault(r["class"], set()).add(r["id"])
    assert sorted(map(sorted, by_class.values())) == [[0, 1, 3], [0, 2]]


def test_copies_of_items_and_documents(spark):
    docs = frame(spark, [doc(k % 5 if k % 2 else None, FILL + QUESTION) for k in range(30)] + [doc(99, "clean")])
    items = benchmark(spark, [QUESTION] * 12 + [None, ""])
    got = decontaminate.leaks(docs, items).collect()
    assert len(got) == 6 * 12 and {r["covered_words"] for r in got} == {len(QUESTION.split())}
    met, _, _ = decontaminate._matches(docs, items)
    assert met.select("class", "item_hash").distinct().count() == 1
    assert [r["doc_id"] for r in decontaminate.drop_leaks(docs, items).collect()] == [99]
