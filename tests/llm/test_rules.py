import hashlib
import re
from collections import Counter

import numpy as np

from caseloom.llm.decontamination import contaminated
from caseloom.llm.pii import private_spans, sanitise
from caseloom.llm.quality_rules import jensen_shannon, judge_quality, measure

from .data import docs, empty, odd

#: The contract's patterns, as written there.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def base(text):
    found = sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if passes(k, m[0]))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)


TRICKY = [
    "a@b.c@d.e x@y a@b.com-x@y.z .@-.- a@b..c a@b.c_d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 000255.1.1.01 1.2.3 12.34.56.78.", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111110000000",
    "+1 (555) 123-4567 ++49 30 1234567 +1 +12345678 +123456789012345678 +4-(9)..999999.", "é😀 a@b.cc 10.0.0.1 😀", "@@@ ++ . - 5", "1" * 5000, "a" * 5000 + "@", "1.1.1.1 " * 300,
]


def test_base_spans(spark):
    rows = docs(spark, [*TRICKY, None, ""])
    for r in private_spans(rows).join(rows.select("doc_id", "text"), "doc_id").collect():
        want = base(r.text)
        assert r.spans == want and r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), r.text
        n = Counter(x.split(":")[0] for x in want.split(",") if x)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in PATTERNS)
    assert private_spans(odd(spark)).count() == 9
    assert private_spans(empty(spark)).count() == 0


def test_disclosing_terms_go(spark):
    plain = [f"nothing to see here number{i} at all" for i in range(120)]
    told = [f"please ask Quorvax about it{'!' * i} mail q@example.org today" for i in range(4)]
    rows = docs(spark, plain + told)
    got = {r.doc_id: r for r in sanitise(rows).collect()}
    assert rows.columns == sanitise(rows).columns
    assert "Quorvax" not in got[120].text and "<EMAIL>" in got[120].text
    assert got[3].text == plain[3]
    spans = {r.doc_id: r.spans for r in private_spans(rows).collect()}
    assert "removed:11:18" in spans[120] and spans[3] == ""
    assert {r.text for r in sanitise(docs(spark, [None, ""])).collect()} == {None, ""}


def test_decontamination(spark):
    item = "So it is said that Anna walked 12 km and then Anna paid 30 euros for the trip home today"
    other = "completely different words that make another item of some fair length for the test here"
    texts = [
        "before " + item.lower().replace("anna", "Bert").replace("12", "15").replace("30", "44") + " after", item.replace("Anna walked", "Bert walked").replace("Anna paid", "Carl paid"),
        "x " + other.upper() + " y", " ".join(other.split()[:9]) + " then something else", None, "", "clean text without any of it",
    ]
    bench = spark.createDataFrame([(7, item, "q"), (8, other, "q"), (9, None, None), (None, item, None), (10, "", "")], "item_id long, text string, hash string")
    assert {(r.doc_id, r.item_id) for r in contaminated(docs(spark, texts), bench).collect()} == {(0, 7), (2, 8)}
    assert contaminated(odd(spark), bench).count() == 0
    assert contaminated(empty(spark), bench).count() == 0
    assert contaminated(odd(spark), bench.limit(0)).count() == 0


def test_decontamination_of_edited_copies(spark):
    one = "the boat of Mara left port at 7 in the morning with some of the fishing crew on board and it came back to the old harbour of the town near the sea at 9 when Mara was done"
    sums = "Tom has 5 apples in his bag. Tom buys 3 more at the shop.\nTom gives all of them away to his friends. How many apples does Tom still have in his bag now"
    w = one.split()
    texts = [
        " ".join([*w[:19], "then", *w[19:]]), " ".join(w[:18] + w[19:]), one.replace("7", "5").replace("9", "5"), sums.replace("Tom", "Ann").replace("5", "6"),
        one.replace("the", "a").replace("of", "by"),
    ]
    bench = spark.createDataFrame([(1, one), (2, sums)], "item_id long, text string")
    found = contaminated(docs(spark, texts), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(0, 1), (1, 1), (2, 1), (3, 2)]


def test_decontamination_recall_on_planted_copies(spark):
    """1,000 copies of items of 36 to 61 words, one to three numbers, names or words edited; and texts that hold none."""
    r = np.random.default_rng(7)
    names, words = ["Mara", "Tom", "Anna", "Lena", "Paul", "Ida", "Kurt", "Nora"], [f"{a}{b}" for a in ("wo", "ta", "ri", "ne", "lo", "su", "ke", "mi") for b in ("rd", "ble", "ver", "st", "ng", "lt", "sh", "pe", "nk", "ra", "do", "fi")]
    items = []
    for i in range(200):
        w = r.choice(words, int(r.integers(36, 62))).tolist()
        at = r.choice(len(w), 6, replace=False)
        n, name = str(r.integers(2, 90)), str(r.choice(names))
        for k, v in zip(at, (n, n, name, name, str(r.integers(100, 900)), str(r.choice(names)))):
            w[k] = v
        items.append((i, w))
    texts, want = [], {}
    for i in range(1000):
        item, w = items[i % 200]
        w = list(w)
        for k in r.choice(len(w), 1 + i % 3, replace=False):
            w[k] = str(r.integers(900, 999)) if w[k].isdigit() else "Otto" if w[k] in names else "edited"
        if i % 3 == 0:  # the hard case: one of two equal numbers or names
            w = list(items[i % 200][1])
            twice = [k for k, x in enumerate(w) if w.count(x) == 2 and (x.isdigit() or x in names)]
            w[twice[i % len(twice)]] = "950" if w[twice[i % len(twice)]].isdigit() else "Otto"
        texts.append(" ".join([*r.choice(words, 30), *w, *r.choice(words, 30)]))
        want[i] = (item, 1 + i % 3)
    texts += [" ".join(r.choice([*words, *names, "7", "12"], 100)) for _ in range(200)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    found = {(x.doc_id, x.item_id) for x in contaminated(docs(spark, texts), bench).collect()}
    by = {n: [(i, item) in found for i, (item, m) in want.items() if m == n] for n in (1, 2, 3)}
    recall = {n: sum(x) / len(x) for n, x in by.items()}
    print("recall by edits", recall)
    assert sum(map(sum, by.values())) >= 900 and recall[1] == 1.0  # three edits may leave less than half of the windows
    assert not [d for d, _ in found if d >= 1000]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    cover = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_quality_counts_and_verdicts(spark):
    r = np.random.default_rng(5)
    texts = [" ".join(r.choice(["the", "of", "and", "largest", "Oak", "river,", "stone."], 80)) for _ in range(60)]
    texts += ["a b c d e f g h " * 5, "x\nx\n \n \nx y", " a b # $", "é" * 30, "### $$$ &&& " * 40 + "q"]
    rows = docs(spark, texts).unionAll(odd(spark))
    got = judge_quality(rows).collect()
    want = Counter((i, *brute(t)) for i, t in [(x.doc_id, x.text) for x in rows.collect()])
    assert Counter((g.doc_id, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) for g in got) == want
    for g in got:
        assert g.base_failed == (g.n_words < 20 or 100 * g.n_repeat_words > 30 * g.n_words) and not (g.kept and g.base_failed)
    assert all(g.kept for g in got if g.doc_id is not None and 9 <= g.doc_id < 60 and not g.base_failed)
    assert judge_quality(empty(spark)).count() == 0
    assert measure(b"")[0] == (0, 0, 0, 0, 0)
    assert jensen_shannon(np.array([[1.0, 0]]), np.array([[1.0, 0], [0, 1.0]])).tolist() == [[0.0, 1.0]]


def plain_added(rows):
    """The added spans by the docstring's rule, on Python sets: {text: spans}."""
    import math

    texts = sorted({t or "" for _, t in rows})
    value = lambda t, s: f"{s[0]}:{t[s[1]:s[2]].lower()}"
    spans = {t: [(x.split(":")[0], *map(int, x.split(":")[1:])) for x in base(t).split(",") if x] for t in texts}
    word = re.compile(r"[^\W\d_]{3,}")
    n_te, n_e, n_t = Counter(), Counter(), Counter()
    for t in texts:
        hidden = t
        for _, a, b in spans[t]:
            hidden = hidden[:a] + "\0" * (b - a) + hidden[b:]
        words, end = [], 0
        cuts = []
        for _, a, b in spans[t]:
            words += [m[0].lower() for m in word.finditer(t[end:a])]
            cuts.append(len(words))
            end = max(end, b)
        words += [m[0].lower() for m in word.finditer(t[end:])]
        n_te.update({(value(t, s), w) for s, c in zip(spans[t], cuts) for w in words[max(0, c - 5) : c + 5]})
        n_e.update({value(t, s) for s in spans[t]})
        n_t.update({m[0].lower() for m in word.finditer(t)})
    best = {}
    for (e, w), n in n_te.items():
        if n >= 3 and n / n_t[w] >= 0.5 and math.log2(n * len(texts) / (n_t[w] * n_e[e])) >= 4:
            best[w] = max(best.get(w, 0), n / n_t[w])
    out = {}
    for t in texts:
        extra = [("removed" if best[m[0].lower()] >= 0.8 else "term", *m.span()) for m in word.finditer(t) if m[0].lower() in best]
        extra = [x for x in extra if not any(a < x[2] and b > x[1] for _, a, b in spans[t])]
        order = {k: i for i, k in enumerate(PATTERNS)}
        out[t] = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans[t] + extra, key=lambda s: (s[1], order.get(s[0], 9))))
    return out


def test_added_spans_equal_the_plain_rule(spark):
    r = np.random.default_rng(8)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("lm", "rt", "nd", "st")]
    texts = []
    for i in range(400):
        w = r.choice(words, int(r.integers(0, 30))).tolist()
        if i % 4 == 0:  # a person's words stand beside their address, at times far away behind a very long word
            who = int(r.integers(0, 6))
            near = [f"Name{'xyzuvw'[who]}yn", "q" * 300 if i % 8 else "!" * 900, f"p{who}@mail.org", "+49 30 1234567" if i % 3 else "", f"street{'abcdef'[who]}lane"]
            at = int(r.integers(0, len(w) + 1))
            w[at:at] = near
        texts.append(" ".join(w))
    rows = docs(spark, [*texts, texts[0], None, *TRICKY])
    want = plain_added([(x.doc_id, x.text) for x in rows.collect()])
    got = private_spans(rows).join(rows.select("doc_id", "text"), "doc_id").collect()
    assert all(g.spans == want[g.text or ""] for g in got)
    assert sum("removed" in g.spans for g in got) > 50 and sum("term:" in g.spans for g in got) >= 0


def test_sanitise_keeps_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "mail a@b.cc", "x", 5, "k", "b", "s"), (None, None, None, None, None, None, None)], "doc_id long, text string, _text string, _id long, terms string, base string, row string")
    got = sorted(map(tuple, sanitise(rows).collect()), key=str)
    assert got == [(1, "mail <EMAIL>", "x", 5, "k", "b", "s"), (None,) * 7]
    assert sanitise(rows).columns == rows.columns


def test_decontamination_of_short_and_numeric_items(spark):
    short, sums = "quick brown foxes jump here", "12 34 56 78 90 12 km 5 6 and 7 8 9 10 add"
    bench = spark.createDataFrame([(1, short), (2, sums), (3, "ok")], "item_id long, text string")
    texts = [short, f"we saw that {short.upper()} and then left", f"x {sums} y z", sums.replace("12", "13"), "quick brown foxes jump over there", "well it is OK, they said", "", None]
    found = {(r.doc_id, r.item_id) for r in contaminated(docs(spark, texts), bench).collect()}
    assert found == {(0, 1), (1, 1), (2, 2), (5, 3)}


def plain_templates(text, wide):
    """Tokens as (slot kind or None, value) by the docstring's rule."""
    from caseloom.llm.decontamination import UNITS

    units, out = set(UNITS.split("|")), []
    for m in re.finditer(r"\d+(?:[.,]\d+)*|[^\W\d_]+", text or ""):
        w, before = m[0], (text or "")[: m.start()]
        if w[0].isdigit():
            out.append(("number", w.replace(",", "_").replace(".", "_")))
        elif out and out[-1][0] == "number" and re.search(r"\d {0,1}$", before) and w.lower() in units:
            out.append(("unit", w.lower()))
        elif w[0].isupper() and w[1:].islower() and (wide or re.search(r"[a-z,;] $", before)):
            out.append(("name", w.lower()))
        else:
            out.append((None, w.lower()))
    return out


def plain_contaminated(rows, items):
    """Windows, shares and what slot values mean, by dicts; one alignment, so for texts without edits inside an item."""
    tell = lambda w: sum(k is None for k, _ in w) >= min(len(w), 4)
    form = lambda w: tuple(k or v for k, v in w) if tell(w) else w
    cut = lambda t, n: [tuple(t[i : i + n]) for i in range(len(t) - n + 1)]
    found = set()
    for doc, text in rows:
        places = {}
        both = [plain_templates(text, wide) for wide in (False, True)]
        for item, t in items:
            for wide in (False, True):
                ti = plain_templates(t, wide)
                n = min(8, len(ti))
                if n not in places:
                    places[n] = {}
                    for td in both:
                        for j, d in enumerate(cut(td, n)):
                            places[n].setdefault(form(d), []).append((j, d))
                wins = cut(ti, n) if ti else []
                forms = {form(w): tell(w) for w in wins}
                lines = {}
                for i, w in enumerate(wins):
                    for j, d in places[n].get(form(w), ()):
                        lines.setdefault(j - i, []).append((form(w), [(a[1], b[1]) for a, b in zip(w, d) if a[0] and tell(w)]))
                for hits in lines.values():
                    said = {}
                    for p in (p for _, ps in hits for p in ps):
                        said[p] = said.get(p, 0) + 1
                    meant = {}
                    for a in {a for a, _ in said}:
                        best, b = max((n, b) for (x, b), n in said.items() if x == a)
                        meant[a] = a if (a, a) in said else b if 3 * best >= 2 * sum(n for (x, _), n in said.items() if x == a) else None
                    got, n_tell = {f for f, ps in hits if all(meant[a] == b for a, b in ps)}, sum(forms.values())
                    enough = (n_tell and sum(forms[f] for f in got) >= 0.5 * n_tell) or len(got) >= 0.5 * len(forms)
                    if enough:
                        found.add((doc, item))
    return found


def test_decontamination_equals_the_plain_rule(spark):
    r = np.random.default_rng(4)
    words = ["boat", "river", "takes", "and", "then", "the", "of", "with", "Mara", "Tom", "Anna", "7", "12", "km", "3.5", "old", "town", "near", "sea"]
    sentence = lambda n: " ".join(r.choice(words, n).tolist()) + "."
    items = [(i, " ".join(sentence(int(r.integers(2, 14))) for _ in range(int(r.integers(1, 4))))) for i in range(25)]
    swap = {"Mara": "Lena", "Tom": "Paul", "7": "9", "12": "40", "3.5": "8"}
    texts = []
    for i in range(120):
        t = items[int(r.integers(0, 25))][1]
        if i % 3 == 0:
            t = re.sub(r"Mara|Tom|3\.5|7|12", lambda m: swap[m[0]], t)
        if i % 3 == 1:
            t = " ".join(w if r.random() > 0.1 else str(r.choice(words)) for w in t.split())
        texts.append(f"{sentence(5)} {t} {sentence(6)}")
    rows = docs(spark, texts)
    got = {(x.doc_id, x.item_id) for x in contaminated(rows, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = plain_contaminated(list(enumerate(texts)), items)
    assert want <= got and len(want) > 80
    assert len(got - want) <= 0.1 * len(want)  # chained alignments find some more
