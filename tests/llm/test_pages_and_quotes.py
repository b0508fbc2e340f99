"""Page trees and quotations against one-at-a-time models."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from reelmill.llm import html_text, quotes

# --- pages


def naive_tree(tokens):
    """Nested lists [tag, children...] by looking through all open elements at every tag."""
    root = ["#page"]
    open_tags = [root]
    for token in tokens:
        if not token.startswith("<"):
            open_tags[-1].append(token)
            continue
        tag = token.strip("</>")
        if token.startswith("</"):
            for i in range(len(open_tags) - 1, 0, -1):
                if open_tags[i][0] == tag:
                    del open_tags[i:]
                    break
            continue
        shut = html_text.CLOSES.get(tag, ()) + (("p",) if tag in html_text.BLOCK else ())
        i = len(open_tags) - 1
        while i > 0:
            if open_tags[i][0] in shut:
                del open_tags[i:]
            elif open_tags[i][0] in html_text.SCOPE:
                break
            i -= 1
        node = [tag]
        open_tags[-1].append(node)
        if tag not in html_text.VOID:
            open_tags.append(node)
    return root


def plain(node):
    return [node.tag, *[p if type(p) is str else plain(p) for p in node.parts]]


def test_trees_by_brute_force():
    rng = random.Random(5)
    tags = "p div li ul ol td th tr tbody table span b a section h1 body dt dd option br".split()
    for _ in range(1500):
        tokens, text = [], True
        for _ in range(rng.randrange(50)):
            text = not text and rng.random() < 0.4
            tokens.append("some words" if text else rng.choice(["<{}>", "<{}>", "</{}>"]).format(rng.choice(tags)))
        assert plain(html_text.parse("".join(tokens))) == naive_tree(tokens), tokens


def naive_text(page):
    """The density rules with every number computed anew from the subtree it is of."""
    root = html_text.parse(page)
    html_text.prune(root)

    def sub(node):
        return [node] + [x for p in node.parts if type(p) is not str for x in sub(p)]

    def chars(node, only_links=False):
        if node.tag == "a":
            only_links = False
        own = 0 if only_links else sum(len("".join(p.split())) for p in node.parts if type(p) is str)
        return own + sum(chars(p, only_links) for p in node.parts if type(p) is not str)

    body = next((n for n in sub(root) if n.tag == "body"), root)
    body = body if chars(body) else root
    share = chars(body, True) / chars(body) if chars(body) else 0

    def density(node):
        c, lc = chars(node), chars(node, True)
        t, lt = max(len(sub(node)) - 1, 1), max(sum(x.tag == "a" for x in sub(node)[1:]), 1)
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        return c / t * max(math.log(max(c / max(lc, 1) * t / lt, 1.0)), 0.01) / max(math.log(base), 1.0) if base > 1 else c / t

    def total(node):
        inner = [p for p in node.parts if type(p) is not str and p.tag in html_text.BLOCK]
        own = 1 - sum(map(chars, inner)) / chars(node) if chars(node) else 0.0
        return sum(map(density, inner)) + own * density(node)

    def largest(node):
        out = node
        for p in node.parts:
            if type(p) is not str and p.tag in html_text.BLOCK and total(largest(p)) > total(out):
                out = largest(p)
        return out

    blocks = [n for n in sub(body) if n.tag in html_text.BLOCK or n is root]
    best = max(blocks, key=total, default=body)
    threshold, node = density(best), best
    while node is not body:
        node = node.parent
        threshold = min(threshold, density(node))
    chosen = {id(largest(n)) for n in blocks if density(n) >= threshold}
    return "\n".join(html_text.block_texts(body, chosen))


def test_density_by_brute_force():
    rng = random.Random(6)

    def make(depth):
        if depth == 0 or rng.random() < 0.2:
            return " ".join(rng.choice(["short", "a longer sentence of words,", "x"]) for _ in range(rng.randrange(1, 9)))
        tag = rng.choice("div p section ul b a span".split())
        return f"<{tag}>" + "".join(make(depth - 1) for _ in range(rng.randrange(1, 4))) + f"</{tag}>"

    for _ in range(150):
        page = "<html><body>" + "".join(make(4) for _ in range(rng.randrange(1, 4))) + "</body></html>"
        assert html_text.main_text(page) == naive_text(page), page


@pytest.mark.parametrize("page", ["<b>{0}</i>{0}", "<span>{0}<p>x{0}", "<div>x{0}", "<ul><li>x{0}", "<p>w{0}", '<div class="ad x">y{0}'])
def test_time_grows_with_length(page):
    def seconds(n):
        begin = time.process_time()
        html_text.main_text("".join(part * n for part in page.split("{0}")))
        return time.process_time() - begin

    assert seconds(40_000) < 16 * max(seconds(10_000), 0.05)  # 16 would be quadratic


# --- quotations

SCHEMA = "conv_id long, turn long, role string, text string"


def test_common_lines_never_decide(spark):
    rows = [
        (1, 0, "u", "Question A about boats"), (1, 1, "a", "> Question A about boats\nyes"), (1, 2, "u", "and this?\nyes"),
        (1, 3, "a", "> Question A about boats\n> yes\nSure"), (1, 4, "u", "> yes\nWhy?"), (1, 5, "a", "> and this?\n> Question A about boats\nboth"),
        (1, 6, "u", ">> Question A about boats\n> Sure\nok"),
    ]
    got = {r.turn: (r.reply_to, r.n_linked) for r in quotes.reply_ordered(spark.createDataFrame(rows, SCHEMA)).collect()}
    # 3: "yes" is said by several; 4: nothing else is linked, so the earliest; 5: most characters; 6: the outermost level
    assert got == {0: (None, 0), 1: (0, 1), 2: (1, 0), 3: (0, 1), 4: (1, 1), 5: (0, 2), 6: (3, 2)}


def naive_replies(rows):
    """Turn to the turn it answers, message by message, by comparing every quoted unit with every earlier message."""
    own, out = {}, {}
    for turn, text in rows:
        runs = []
        for line in text.split("\n"):
            level = len(line) - len(line.lstrip(">"))
            if not runs or runs[-1][0] != level:
                runs.append((level, []))
            runs[-1][1].append(quotes.normal(line.lstrip(">")))
        own[turn] = runs

    def says(turn):
        mine = [lines for level, lines in own[turn] if level == 0]
        return {n for n in [*map(" ".join, mine), *sum(mine, []), " ".join(sum(mine, []))] if n}

    for turn, _ in rows:
        votes = {}
        for level, lines in own[turn]:
            if not level:
                continue
            for is_line, parts in (False, [" ".join(lines)]), (True, lines):
                found = 0
                for x in filter(None, parts):
                    sayers = [t for t in own if x in says(t)]
                    if sayers and sayers[0] < turn and (not is_line or len(sayers) == 1):
                        key = (-level, len(sayers) == 1, sayers[0])
                        votes[key] = votes.get(key, 0) + len(x)
                        found += 1
                if found:
                    break
        best = max(votes, key=lambda k: (k[0], k[1], votes[k], k[2]), default=None)
        out[turn] = best[2] if best else turn - 1 if turn else None
    return out


def test_replies_by_brute_force(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for conv in range(25):
        talk, lines = [], ["yes", "no", "a b c", "boats and more", "why so"]
        for turn in range(12):
            text = [">" * rng.choice([0, 0, 1, 1, 2]) + rng.choice(lines) for _ in range(rng.randrange(1, 6))]
            if rng.random() < 0.6:
                lines.append(f"line {conv} {turn}")
                text.append(lines[-1])
            talk.append((turn, "\n".join(text)))
        rows += [(conv, t, "u", x) for t, x in talk]
        want |= {(conv, t): up for t, up in naive_replies(talk).items()}
    got = {(r.conv_id, r.turn): r.reply_to for r in quotes.reply_ordered(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_brothers_across_ranges(spark):
    """A message with most of the answers: the next brother is right also where a range of the table ends."""
    rows = [("c", (i, 0), (-1, 0)) for i in range(900)] + [("d", (i, 0), (i % 3, 0)) for i in range(90)]
    df = spark.createDataFrame(rows, "c string, m struct<turn:long,tie:long>, up struct<turn:long,tie:long>")
    got = {(r.c, r.m.turn): r.next and r.next.turn for r in quotes.with_next(df.repartition(7)).collect()}
    want = {("c", i): i + 1 if i < 899 else None for i in range(900)} | {("d", i): i + 3 if i + 3 < 90 else None for i in range(90)}
    assert got == want
    assert quotes.with_next(df.where(F.lit(False))).count() == 0
