"""Machines made of machines, row by row."""

from tidemark.operators import machines


def feed(machine, rows):
    state, out = machine.start(), []
    for row in rows:
        state, made = machine.step(state, row)
        out += made
    return out + machine.finish(state)


def total():
    return machines.Stateful(0, lambda s, row: (s + row[0], [(s + row[0],)]), lambda s: [("end", s)])


def test_stages_in_a_row_get_what_the_first_puts_out_at_its_end():
    count = machines.Stateful(0, lambda n, row: (n + 1, []), lambda n: [(n,)])
    assert feed(machines.AndThen(count, total()), [(5,), (6,)]) == [(2,), ("end", 2)]
    pairs = machines.stateless(lambda row: [row, row])
    assert feed(machines.AndThen(pairs, total()), [(1,), (2,)]) == [(1,), (2,), (4,), (6,), ("end", 6)]


def test_either_side_has_its_own_state():
    rows = [("R", 1), ("L", 2), ("R", 3), ("L", 4)]
    side = lambda step: machines.Stateful(0, lambda s, row: (s + step, [(row[0], s + step)]))
    both = machines.Choice(lambda row: row[0] == "L", side(1), side(2))
    assert feed(both, rows) == [("R", 2), ("L", 1), ("R", 4), ("L", 2)]
    assert feed(machines.left(side(1), lambda row: row[0] == "L"), rows) == [("R", 1), ("L", 1), ("R", 3), ("L", 2)]
    assert feed(machines.right(side(2), lambda row: row[0] == "L"), rows) == [("R", 2), ("L", 2), ("R", 4), ("L", 4)]


def test_parts_of_rows():
    add = machines.Stateful(0, lambda s, row: (s + row[0], [(s + row[0],)]))
    assert feed(machines.on(add, 1), [("a", 1), ("b", 2)]) == [("a", 1), ("b", 3)]
    assert feed(machines.semipass(add, lambda row: (True, row) if row[0] > 0 else (False, ("kept", *row))), [(1,), (-1,), (2,)]) == [(1,), ("kept", -1), (3,)]
    assert feed(machines.contramap(add, lambda row: (len(row[0]),)), [("ab",), ("c",)]) == [(2,), (3,)]
    assert feed(machines.Dimap(add, lambda row: (row[0] * 2,), lambda row: (row[0] + 1,)), [(1,), (2,)]) == [(3,), (7,)]
    assert feed(machines.lift(lambda row: (row[0] + 1,)), [(1,)]) == [(2,)]
