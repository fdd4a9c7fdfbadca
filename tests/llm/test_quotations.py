import random
import re

from driftkit.llm import quotations as Q

SCHEMA = "conv_id long, turn long, role string, text string, conv int, level int, hash int, thread string, depth string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "t", "d") for r in rows], SCHEMA)


def linked(spark, rows):
    return sorted((tuple(r) for r in Q.linked_conversations(table(spark, rows)).collect()), key=str)


def read(text):
    """Own text and passages by level, line by line."""
    lines = []
    for line in re.split("\r?\n", text or ""):
        head = re.match(r"(?:[ \t]*>)*", line)[0]
        lines.append((head.count(">"), line[len(head) :].strip(" ")))
    keep = [
        (level, body) for k, (level, body) in enumerate(lines)
        if not (re.search(r"(wrote|schrieb|a écrit|escribió) ?:$", body, re.I) and k + 1 < len(lines) and lines[k + 1][0] > level)
    ]
    found, run, at = set(), [], None
    for level, body in [*keep, (None, "")]:
        if level != at:
            for p in re.split(r"(?<=[.!?])\s+", " ".join(run)):
                if p.strip():
                    found.add((at, " ".join(p.lower().split())))
            run, at = [], level
        run.append(body)
    return "\n".join(b for level, b in keep if level == 0).strip(), found


def brute(rows):
    messages = [(c, t, r, *read(x)) for c, t, r, x in rows]
    out = []
    parents = {}
    for c, t, *_ in messages:
        if c is None or t is None:
            continue
        quoted = {(level, p) for a, b, _, _, f in messages if (a, b) == (c, t) for level, p in f if level}
        votes, linked_ = {}, 0
        for level, p in quoted:
            source = max((b for a, b, _, _, f in messages if a == c and b is not None and b < t and (0, p) in f), default=None)
            linked_ += source is not None
            if level == 1 and source is not None:
                votes[source] = votes.get(source, 0) + 1
        parents[c, t] = (max(votes, key=lambda s: (votes[s], s)) if votes else None, len(quoted), linked_)
    for c, t, r, own, _ in messages:
        parent, n, k = parents.get((c, t), (None, 0, 0))
        top, depth = t, 0
        while (c, top) in parents and parents[c, top][0] is not None:
            top, depth = parents[c, top][0], depth + 1
        out.append((c, t, r, parent, top, depth, n, k, own))
    return sorted(out, key=str)


MAIL = [
    (1, 0, "a", "Hello there. How are\nyou today? Fine."),
    (1, 1, "b", "Good!\n\nOn Monday a wrote:\n> Hello there. How are you\n> today?\n"),
    (1, 2, "a", "> Good!\n>> Hello   THERE.\nThanks.\n> unknown words.\nBye."),
    (1, 3, "c", "b schrieb:\n> Thanks. Bye.\n> > Good!\n\nAnswer below."),
    (1, 5, "c", "no quote, a > b and wrote:"), (1, 6, "d", "> > > deep only.\n"), (1, 6, "d", "> Answer below."),
    (2, 0, "a", None), (2, 1, "a", ""), (2, 2, "b", "> Hello there."), (None, 1, "x", "> Good!"), (1, None, "x", "> Good!"), (None, None, None, None),
]


def test_example(spark):
    found = {(r[0], r[1]): r for r in linked(spark, MAIL)}
    assert found[1, 1][3:] == (0, 0, 1, 2, 2, "Good!")
    assert found[1, 2][3:] == (1, 0, 2, 3, 2, "Thanks.\nBye.")
    assert found[1, 3][3:] == (2, 0, 3, 3, 3, "Answer below.")
    assert found[2, 2][3:] == (None, 2, 0, 1, 0, "")


def test_equals_brute_force(spark):
    assert linked(spark, MAIL) == brute(MAIL)


def test_random_mail_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(Q, "RANGE", 3)
    draw = random.Random(8)
    rows = []
    for c in range(6):
        sent = []
        for t in sorted(draw.sample(range(40), 14)):
            text = "\n".join(draw.choice(["Yes.", "No way!", f"Point {t}.", f"Idea {draw.randint(0, 5)}. More"]) for _ in range(draw.randint(0, 3)))
            if sent and draw.random() < 0.7:
                text += "\nx wrote:\n" + "\n".join("> " + line for line in draw.choice(sent).split("\n"))
            sent.append(text)
            rows.append((c, t, draw.choice("ab"), text))
    assert linked(spark, rows) == brute(rows)


def test_one_conversation_with_one_repeated_passage(spark):
    rows = [(1, t, "a", "Yes." if t % 2 == 0 else "> Yes.") for t in range(300)]
    found = {r[1]: r for r in linked(spark, rows)}
    assert all(found[t][3] == t - 1 for t in range(1, 300, 2))


def test_empty_table_and_no_python(spark):
    none = table(spark, [])
    assert Q.linked_conversations(none).collect() == []
    plan = Q.linked_conversations(table(spark, MAIL))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
