"""Footer notes against a plain reading of the rules, line by line."""

import random
import re

from clausemill.functions import notes

TITLES = [None, "Short", "Sizes of conductors", "Cable (a+b) sizes"]


def plainly(page, number, title):
    text = page.replace("\r\n", "\n").replace("\r", "\n")
    label = re.sub(r"(?i)^table\s+", "", (number or "").strip()).strip()
    named = (title or "").strip()
    ways = ([rf"\btable\s+{re.escape(label)}\b", rf"\btable{re.escape(label)}\b"] if label else []) + ([re.escape(named[:80])] if len(named) >= 8 else [])
    hits = [m for m in (re.search(w, text, re.I) for w in ways) if m]
    if ways and not hits:
        return []
    start = hits[0].start() if hits else 0
    cut = re.search(r"(?im)^\s*table\s+\S+", text[start + 1 :])
    mine = text[start : start + 1 + cut.start()] if cut else text[start:]
    head = re.search(r"(?i)\bnotes?\b", mine)
    kind = "notes" if head else "exceptions"
    head = head or re.search(r"(?i)\bexceptions?\b", mine)
    if not head:
        return []
    lines = [x.strip() for x in mine[head.start() :].split("\n")]
    groups = []  # each a list of lines; a closed one takes no more
    open_ = False
    if kind == "exceptions":
        groups.append([lines[0]])
    else:
        lines[0:1] = ["", re.sub(r"(?i)^notes?\b\s*[:\-–—]?\s*", "", lines[0])]
    for x in filter(None, lines[1:]):
        if kind == "notes" and groups and (re.match(r"(?i)copyright\b", x) or re.fullmatch(r"(?i)(table|figure|clause)\s+\S+|appendix|note|source", x)):
            break
        if kind == "notes" and re.match(r"(?i)exceptions?\b", x):
            groups.append([x])
            open_ = False
        elif re.match(r"(?i)\(\d{1,3}\)|\d{1,3}\s*[.):]|\([a-z]\)|[a-z]\s*[.):]", x):
            groups.append([x])
            open_ = True
        else:
            if open_:
                groups[-1].append(x)
            elif len(x) <= 260 and re.search("[A-Za-z]", x):
                groups.append([x])
                open_ = True
            if kind == "notes" and len(groups) - open_ >= 60:
                break
    out = {}
    for g in groups:
        one = re.sub(r"\s+", " ", " ".join(g)).strip()
        out.setdefault(one.lower(), one)
    return list(out.values())


LINES = [
    "TABLE 3.1", "Table 3.1 Sizes of conductors", "TABLE3.1", "TABLE 3.2", "Sizes of conductors", "cable (A+B) sizes", "NOTES:", "Notes: first words", "NOTE", "NOTE - one", "EXCEPTIONS", "Exception to the above", "EXCEPTIONS TO TABLE 3.1",
    "1. one", "2) two", "(3) three", "4 : four", "(a) letter", "b. other", "1. ONE", "goes  on", "12.5", "x" * 300, "", "  ", "COPYRIGHT", "Copyright of us", "FIGURE 2", "CLAUSE 3.1", "Appendix", "SOURCE", "| 1 | 2 |",
]


def test_random_pages(spark):
    r = random.Random(7)
    rows = []
    for i in range(1500):
        page = r.choice(["\n", "\r\n", "\n"]).join(r.choices(LINES, k=r.randrange(14)))
        rows.append((i, page, r.choice([None, "Table 3.1", "3.1", "TABLE 3.2", ""]), r.choice(TITLES)))
    df = spark.createDataFrame(rows, "id long, page string, number string, title string")
    found = {x.id: x.notes for x in notes.with_notes(df, df.page, df.number, df.title).collect()}
    assert any(found.values())
    for i, page, number, title in rows:
        assert found[i] == plainly(page, number, title), (page, number, title)


def test_no_more_than_sixty_without_a_number(spark):
    page = "TABLE 1\nNOTES\n" + "\n".join(f"{i % 99 + 1}. item {i}\ngoes on" for i in range(90))
    df = spark.createDataFrame([(page, "1", None)], "page string, number string, title string")
    found = notes.with_notes(df, df.page, df.number, df.title).first().notes
    assert found == plainly(page, "1", None) and len(found) == 61
