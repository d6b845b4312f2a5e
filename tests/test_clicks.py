import random

from conftest import tuples

from pagework.operators import clicks as cl

CLICKS = "doc_id bigint, seq bigint, action string, page_id bigint, target_id bigint"


def replay(n, clicks):
    """The list of pages as the clicks change it: (id, page, turn)."""
    pages, free = [(i, i, 0) for i in range(1, n + 1)], n + 1
    for action, page, target in clicks:
        at = next((i for i, p in enumerate(pages) if p[0] == page), None)
        if action == "reset":
            pages, free = [(i, i, 0) for i in range(1, n + 1)], n + 1
        elif at is None:
            continue
        elif action == "rotate":
            pages[at] = (page, pages[at][1], (pages[at][2] + 90) % 360)
        elif action == "duplicate":
            pages.insert(at + 1, (free, *pages[at][1:]))
            free += 1
        elif action == "delete" and len(pages) > 1:
            del pages[at]
        elif action == "move" and page != target:
            to = next((i for i, p in enumerate(pages) if p[0] == target), None)
            if to is not None:
                pages.insert(to, pages.pop(at))
    return [(i, p, t, k) for i, (k, p, t) in enumerate(pages, 1)]


def test_random_logs_equal_a_list_replay(table):
    rng = random.Random(17)
    counts = {d: rng.choice([1, 2, 3, 8, 30]) for d in range(1, 41)}
    log, expected = [], []
    for d, n in counts.items():
        actions = ["rotate", "duplicate", "delete", "move", "move", *(["reset"] if d % 4 == 0 else [])]
        mine = [(rng.choice(actions), rng.randrange(0, n + 6), rng.randrange(0, n + 6)) for _ in range(rng.randrange(1, 50))]
        log += [(d, 10 * s, *c) for s, c in enumerate(mine)]
        expected += [(d, *row) for row in replay(n, mine)]
    rng.shuffle(log)
    found = cl.replay_clicks(table(CLICKS, log), table("doc_id bigint, page_count int", [*counts.items(), (99, 5)]))
    assert tuples(found.rows, "doc_id", "out_no", "page_no", "rotation", "page_id") == sorted(expected)
    assert found.errors.count() == 0


def test_several_moves_of_one_document(table, small_blocks):
    moves = [(1, 1, "move", 1, 9), (1, 2, "move", 9, 2), (1, 3, "move", 1, 3), (1, 4, "move", 5, 5), (1, 5, "move", 7, 77)]
    found = cl.replay_clicks(table(CLICKS, moves), table("doc_id bigint, page_count int", [(1, 9)]))
    assert tuples(found.rows, "doc_id", "out_no", "page_no", "rotation", "page_id") == [(1, *r) for r in replay(9, [m[2:] for m in moves])]


def test_the_last_page_stays_and_copies_can_be_clicked(table):
    log = [(1, 1, "delete", 1, None), (1, 2, "rotate", 1, None), (1, 3, "duplicate", 1, None), (1, 4, "rotate", 2, None), (1, 5, "delete", 1, None)]
    log += [(1, 6, "duplicate", 2, None), (1, 7, "delete", 2, None), (1, 8, "delete", 3, None)]
    found = cl.replay_clicks(table(CLICKS, log), table("doc_id bigint, page_count int", [(1, 1)]))
    assert tuples(found.rows) == [(1, 1, 1, 180, 3)]


def test_bad_logs_are_error_rows(table):
    log = [(1, 1, "rotate", 1, None), (2, 1, "fold", 1, None), (2, 2, None, 1, None), (3, 1, None, None, None), (8, 1, "rotate", 1, None), (None, 1, "rotate", 1, None)]
    log += [(4, None, "rotate", None, None), (4, 1, "move", 1, None)]
    found = cl.replay_clicks(table(CLICKS, log), table("doc_id bigint, page_count int", [(d, 2) for d in range(1, 6)]))
    assert tuples(found.rows, "doc_id", "out_no", "page_no", "rotation") == [(1, 1, 1, 90), (1, 2, 2, 0), (4, 1, 1, 0), (4, 2, 2, 0)]
    said = {r["doc_id"]: r["errors"] for r in found.errors.collect()}
    assert said == {2: ["Unknown action: fold"], 3: ["Unknown action: null"], 8: ["File not found: 8"], None: ["File not found: "]}


def test_pages_are_made_at_the_end_and_no_python_runs(table):
    found = cl.replay_clicks(table(CLICKS, [(1, 1, "move", 1, 400_000)]), table("doc_id bigint, page_count int", [(1, 400_000)]))
    plan = found.rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert found.rows.where("page_no = 1").first()["out_no"] == 400_000 and found.rows.count() == 400_000
