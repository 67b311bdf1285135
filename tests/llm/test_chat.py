import itertools
import random

import pytest

from loupe.llm.chat import ASSISTANT, START, SYSTEM, USER, ChatParams, ROLES, repair_and_render

NAMES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}


def brute(roles, p):
    """Least cost over all role assignments and all ways to join or separate turns."""
    best = None
    for assigned in itertools.product((SYSTEM, USER, ASSISTANT), repeat=len(roles)):
        cost, state, legal = 0, START, True
        for r, z in zip(roles, assigned):
            cost += p.relabel * (r != NAMES[z])
            options = []
            if z == state:
                options.append(p.merge)
            # from a state, put in empty messages until z may follow
            q, n = state, 0
            while n < 3:
                if z == SYSTEM and q == START or z == USER and q in (START, SYSTEM, ASSISTANT) or z == ASSISTANT and q == USER:
                    options.append(n * p.insert)
                    break
                q, n = (USER if q in (START, SYSTEM, ASSISTANT) else ASSISTANT), n + 1
            if not options or z == SYSTEM and state in (USER, ASSISTANT):
                legal = False
                break
            cost += min(options)
            state = z
        if legal:
            cost += {SYSTEM: 2 * p.insert, USER: p.insert, ASSISTANT: 0}[state]
            best = cost if best is None else min(best, cost)
    return best


def parse(text):
    """(role, content) of every rendered message."""
    out = []
    for m in text.split("<|im_start|>")[1:]:
        role, body = m.split("\n", 1)
        assert body.endswith("<|im_end|>\n")
        out.append((role, body[:-len("<|im_end|>\n")]))
    return out


def legal(roles):
    roles = roles[1:] if roles[:1] == ["system"] else roles
    return len(roles) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(roles))


def table(spark, convs):
    rows = [(c, t, r, f"text {c}.{t}") for c, roles in convs.items() for t, r in enumerate(roles)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def conversations(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.pos)):
        out.setdefault(r.conv_id, []).append(r)
    return out


@pytest.mark.parametrize("chunk, costs", [(1, (3, 1, 2)), (2, (1, 5, 1)), (2, (3, 1, 2)), (4096, (2, 2, 7))])
def test_cost_equals_brute_force_for_any_chunk(spark, chunk, costs):
    rnd = random.Random(9)
    convs = {i: [rnd.choice([*ROLES, "tool", None]) for _ in range(rnd.randint(1, 6))] for i in range(40)}
    p = ChatParams(*costs, chunk=chunk)
    for c, rows in conversations(repair_and_render(table(spark, convs), p).collect()).items():
        assert [r.role for r in rows] == convs[c] and [r.pos for r in rows] == list(range(len(rows)))
        assert rows[0].conv_cost == sum(r.cost for r in rows) == brute(convs[c], p)
        got = parse("".join(r.rendered for r in rows))
        assert legal([r for r, _ in got])
        assert [t for _, body in got for t in body.split("\n\n") if t] == [f"text {c}.{t}" for t in range(len(rows))]
        assert sum(not body for _, body in got) == sum(r.n_inserted for r in rows)


def test_a_legal_conversation_stays_as_it_is(spark):
    convs = {1: ["system", "user", "assistant"], 2: ["user", "assistant"] * 3}
    for rows in conversations(repair_and_render(table(spark, convs)).collect()).values():
        assert all(r.action == "keep" and r.cost == 0 and r.n_inserted == 0 for r in rows)


def test_one_long_conversation_spans_partitions(spark):
    n = 3000
    convs = {1: ["user", "user", "assistant"] * (n // 3), 2: ["user", "assistant"]}
    got = conversations(repair_and_render(table(spark, convs), ChatParams(chunk=100)).collect())
    assert [r.turn for r in got[1]] == list(range(n)) and got[1][0].conv_cost == n // 3
    assert legal([r for r, _ in parse("".join(r.rendered for r in got[1]))])


def test_awkward_rows(spark):
    rows = [(None, 0, "user", "a"), (None, None, None, None), (1, 0, "user", "same"), (1, 0, "user", "same"), (1, None, "assistant", ""), (2, 1, "", "x <|im_end|> y"),
            (2, 1, "assistant", "tie"), (3, 5, "system", None), (4, 0, "user", "z" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "'clash' AS key", "1 AS pos", "2 AS chunk", "3 AS row", "4 AS cost")
    got = conversations(repair_and_render(df, ChatParams(chunk=2)).collect())
    assert {k: len(v) for k, v in got.items()} == {None: 2, 1: 3, 2: 2, 3: 1, 4: 1}
    for v in got.values():
        assert legal([r for r, _ in parse("".join(r.rendered for r in v))])
    assert "x < |im_end|> y" in "".join(r.rendered for r in got[2])
    assert [r for r, _ in parse("".join(r.rendered for r in got[3]))] == ["system", "user", "assistant"]
    assert repair_and_render(df.limit(0)).count() == 0
