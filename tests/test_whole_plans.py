"""Plans that once left a part of the job out."""

from collections import Counter

from evenkeel.plans import greedy
from evenkeel.plans.grid import Grid, change_grid, merge_sends


def test_volume_counts_what_stands_in_for_missing_cells(spark):
    from evenkeel.queries import matrix_mig_volume

    got, sent = Counter(), Counter()
    for m in matrix_mig_volume(spark, "/root/testdata/sf0.001").collect():
        assert m["from_node"] != m["to_node"]
        got[m["side"]] += m["fraction"]
    for _, _, side, lo, hi in change_grid(Grid(2, 2), Grid(3, 3, "col", 2), 1500, 150).sends:
        sent[side] += hi - lo
    assert abs(got["R"] - sent["R"] - 1 / 3) < 1e-9 and abs(got["S"] - sent["S"]) < 1e-9
    assert all(a != b for a, b, _ in merge_sends(change_grid(Grid(3, 2), Grid(3, 2, "col", 2), 1000, 600)))


def test_many_small_keys_meet_a_large_excess_without_a_split():
    items = [(k, 100 + k * 37 % 101) for k in range(3000)]
    assert sum(dict(items)[k] for k in greedy.subset_near(items, 250_000, 0)) == 250_000
    plan = greedy.split_last({0: dict(items), 1: {}, 2: {}})
    assert len({k for _, _, k, _ in plan}) == len(plan) and all(n == dict(items)[k] for _, _, k, n in plan)


def test_bits_choose_what_the_list_of_sums_chooses():
    for n in range(1, 12):
        items = [(k, 1 + (k * 17 + n * 5) % 23) for k in range(n)]
        for goal in range(23, 120, 7):
            assert greedy.subset_near(items, goal, 5) == greedy._subset_by_bits(items, goal, 5)
