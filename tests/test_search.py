import datetime
import random

import pytest
from conftest import tuples
from pyspark.sql import functions as F

from pagework.operators import search as se
from pagework.streaming import live_index as li

START = datetime.datetime(2024, 1, 1)
OPENS = "owner bigint, file_path string, ts timestamp_ntz"


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def test_index_and_cap(table):
    opens = table(OPENS, [(1, r"C:\a\x.pdf", at(1)), (1, r"C:\a\x.pdf", at(5)), (1, "/b/y.pdf", at(5)), (2, "/b/y.pdf", at(0))])
    index = se.build_index(opens)
    assert tuples(index, "owner", "file_path", "file_name", "open_count", "last_opened") == [
        (1, "/b/y.pdf", "y.pdf", 1, at(5)),
        (1, r"C:\a\x.pdf", "x.pdf", 2, at(5)),
        (2, "/b/y.pdf", "y.pdf", 1, at(0)),
    ]
    assert tuples(se.cap_index(index, 1), "owner", "file_path") == [(1, "/b/y.pdf"), (2, "/b/y.pdf")]


def test_search_order(table):
    index = se.build_index(
        table(OPENS, [(1, "/Tax/a.pdf", at(9)), (1, "/x/TAX.pdf", at(1)), (1, "/x/mytax.pdf", at(2)), (1, "/x/b.pdf", at(3)), (2, "/tax.pdf", at(0))])
    )
    queries = table("owner bigint, query string", [(1, "tax"), (1, " "), (1, "tax "), (1, "\ufeff"), (2, "zzz")])
    hits = se.search_index(index, queries)
    assert [r[2] for r in tuples(hits, "query", "rank", "file_path")] == ["/x/mytax.pdf", "/x/TAX.pdf", "/Tax/a.pdf"]
    assert tuples(se.top_hits(hits, 2), "rank") == [(1,), (2,)]
    files = table("file_path string, file_size bigint", [("/x/TAX.pdf", 3), ("/Tax/a.pdf", 0)])
    assert tuples(se.flag_missing(hits, files), "file_path", "is_missing") == [
        ("/Tax/a.pdf", True), ("/x/TAX.pdf", False), ("/x/mytax.pdf", True),
    ]


@pytest.mark.parametrize("bucket", ["hour", "day", "month"])
def test_effective_opens_against_brute_force(table, bucket):
    rng = random.Random(11)
    actions = ["enable", "disable", "enable", "none"]
    control = [(o, at(rng.randrange(0, 9000)), rng.choice(actions)) for o in (1, 2, 3) for _ in range(40)]
    control += [(1, at(2000), "clear"), (1, at(2500), "clear"), (2, at(0), "clear")]
    opens = [(o, f"/f{k}.pdf", at(rng.randrange(0, 9000))) for o in (1, 2, 3, 4) for k in range(150)]
    opens += [(1, "/tie.pdf", at(2500))]
    want = []
    for owner, path, ts in opens:
        mine = [c for c in control if c[0] == owner]
        switches = sorted((t, a == "enable") for _, t, a in mine if t <= ts and a in ("enable", "disable"))
        cleared = max((t for _, t, a in mine if a == "clear"), default=START)
        if switches and switches[-1][1] and ts >= cleared:
            want.append((owner, path, ts))
    got = se.effective_opens(table(OPENS, opens), table("owner bigint, ts timestamp_ntz, action string", control), bucket)
    assert tuples(got) == sorted(want)


def test_enabled_now(table):
    control = table(
        "owner bigint, ts timestamp_ntz, action string",
        [(1, at(0), "enable"), (1, at(1), "clear"), (2, at(0), "enable"), (2, at(1), "disable"), (3, at(1), "clear")],
    )
    assert tuples(se.enabled_now(control)) == [(1,)]


def write_batches(table, folder, batches):
    """One file per micro-batch, in order."""
    for rows in batches:
        table(OPENS, rows).coalesce(1).write.mode("append").parquet(folder)


def opens_stream(spark, folder):
    return li.read_opens(spark, folder, ["owner", "file_path", "ts"], OPENS, files_per_batch=1)


def test_stream_equals_batch(spark, table, tmp_path):
    rng, source, state = random.Random(5), str(tmp_path / "in"), str(tmp_path / "state")
    batches = [[(rng.randrange(3), f"/f{rng.randrange(12)}.pdf", at(rng.randrange(500))) for _ in range(60)] for _ in range(3)]
    write_batches(table, source, batches[:2])
    li.start_live_index(opens_stream(spark, source), state, keep=4).awaitTermination()
    write_batches(table, source, batches[2:])
    live = li.finish(spark, li.start_live_index(opens_stream(spark, source), state, keep=4), state)
    whole = se.cap_index(se.build_index(table(OPENS, sum(batches, []))), 4)
    assert tuples(live, *li.COLUMNS) == tuples(whole, *li.COLUMNS)


def test_bounded_stream_forgets_what_fell_out(spark, table, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    write_batches(table, source, [[(1, "/a.pdf", at(1)), (1, "/a.pdf", at(2)), (1, "/b.pdf", at(3)), (1, "/b.pdf", at(4))]])
    write_batches(table, source, [[(1, "/c.pdf", at(5)), (1, "/b.pdf", at(6))]])
    write_batches(table, source, [[(1, "/a.pdf", at(7))]])
    live = li.finish(spark, li.start_bounded_index(opens_stream(spark, source), state, keep=2), state)
    assert tuples(live, "file_path", "open_count", "last_opened") == [("/a.pdf", 1, at(7)), ("/b.pdf", 3, at(6))]


def replay(opens, keep):
    """Every open taken in one by one, as a list that is cut to the latest ``keep``."""
    files = {}
    for owner, path, ts in sorted(opens, key=lambda o: (o[0], o[2], [-ord(c) for c in o[1]])):
        held = files.setdefault(owner, [])
        entry = next((f for f in held if f[0] == path), None)
        if entry:
            held.remove(entry)
        held.append((path, entry[1] + 1 if entry else 1, ts))
        del held[: max(0, len(held) - keep)]
    return sorted((owner, path, count, last) for owner, held in files.items() for path, count, last in held)


def random_opens(seed, count=900, owners=3, paths=14, minutes=400):
    """Mostly of one owner, with instants that repeat and favourite files that come back after long gaps."""
    rng = random.Random(seed)
    path = lambda: f"/f{min(rng.randrange(paths), rng.randrange(paths))}.pdf"
    return [(rng.choice([0, 0, 0, *range(owners)]), path(), at(rng.randrange(minutes))) for _ in range(count)]


@pytest.mark.parametrize("keep", [1, 2, 5, 9, 40])
def test_recent_index_equals_a_replay_of_every_open(spark, table, keep):
    opens = random_opens(keep)
    df = table(OPENS, opens + [(1, None, at(0)), (None, "/a.pdf", at(0)), (1, "/a.pdf", None)])
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = se.recent_index(df, keep)
        assert tuples(found, "owner", "file_path", "open_count", "last_opened") == replay(opens, keep)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_stretches_join_to_the_whole():
    from pagework.operators.recency import Stretch

    rng = random.Random(4)
    for _ in range(300):
        keep, opens = rng.randrange(1, 7), [(f"/{rng.randrange(9)}", n, 1) for n in range(rng.randrange(0, 60))]
        whole, cuts = Stretch(keep), sorted(rng.randrange(0, len(opens) + 1) for _ in range(rng.randrange(0, 6)))
        for one in opens:
            whole.open(*one)
        parts = []
        for a, b in zip([0, *cuts], [*cuts, len(opens)]):
            parts.append(Stretch(keep))
            for one in opens[a:b]:
                parts[-1].open(*one)
        while len(parts) > 1:  # in any grouping
            i = rng.randrange(len(parts) - 1)
            parts[i : i + 2] = [parts[i].join(parts[i + 1])]
        assert parts[0].entries() == whole.entries() and list(parts[0].first) == list(whole.first)


@pytest.mark.parametrize("pieces", [1, 2, 7])
def test_any_split_into_batches_gives_one_result(spark, table, tmp_path, pieces):
    opens = sorted(random_opens(21, 240, minutes=10_000), key=lambda o: (o[2], [-ord(c) for c in o[1]]))
    source, state, size = str(tmp_path / "in"), str(tmp_path / "state"), -(-len(opens) // pieces)
    write_batches(table, source, [opens[i : i + size] for i in range(0, len(opens), size)])
    live = li.finish(spark, li.start_recent_index(opens_stream(spark, source), state, keep=4, buckets=3), state)
    assert tuples(live, "owner", "file_path", "open_count", "last_opened") == replay(opens, 4)


def test_batches_write_the_buckets_of_their_owners_only(spark, table, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    owners = list(range(12))
    write_batches(table, source, [[(o, "/a.pdf", at(1)) for o in owners], [(5, "/b.pdf", at(2))], [(5, "/a.pdf", at(3)), (5, "/c.pdf", at(4))]])
    live = li.finish(spark, li.start_recent_index(opens_stream(spark, source), state, keep=2, buckets=4), state)
    assert tuples(live, "owner", "file_path", "open_count") == sorted([(o, "/a.pdf", 1) for o in owners if o != 5] + [(5, "/a.pdf", 2), (5, "/c.pdf", 1)])
    bucket = dict(tuples(spark.range(12).select(F.col("id").alias("owner")).select("owner", li.bucket_of(4))))
    mine = bucket[5]
    data = tmp_path / "state" / "index" / "data"
    assert {p.name for p in (data / "version=0").iterdir() if p.name.startswith("bucket")} == {f"bucket={b}" for b in bucket.values() if b != mine}
    for version in (1, 2):
        assert [p.name for p in (data / f"version={version}").iterdir() if p.name.startswith("bucket")] == [f"bucket={mine}"]


def test_a_batch_that_is_run_again_counts_once(spark, table, tmp_path):
    folder = str(tmp_path / "index")
    write = li._keep_buckets(folder, lambda batch, before: se.recent_index(batch, 3, before), 2)
    one, two = table(OPENS, [(1, "/a.pdf", at(1))]), table(OPENS, [(1, "/a.pdf", at(2)), (2, "/b.pdf", at(3))])
    for batch, number in ((one, 0), (one, 0), (two, 1), (two, 1), (table(OPENS, []), 2), (two.limit(0), 3)):
        write(batch, number)
    found = li._read(spark, folder, li._pointer(spark, folder, 3))
    assert tuples(found, "owner", "file_path", "open_count") == [(1, "/a.pdf", 2), (2, "/b.pdf", 1)]
