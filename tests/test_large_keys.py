"""Queries over tables whose keys are larger than the fields of a binary format, against their SQL."""

import duckdb

from tidemark import catalog


def equal(spark, folder, name, events):
    """Whether a query's rows over events (event_id, user_id, event_type) are those of its SQL."""
    db = duckdb.connect()
    db.sql("create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double)")
    db.executemany("insert into events values (?, timestamp '2024-01-01' + interval (?) minute, ?, ?, ?)", [(i, k, u, t, float(k)) for k, (i, u, t) in enumerate(events)])
    db.sql(f"copy events to '{folder}/events.parquet' (format parquet)")
    df = catalog.queries()[name](spark, str(folder))
    names = sorted(df.columns)
    mine = sorted(map(str, (tuple(r[c] for c in names) for r in df.collect())))
    theirs = db.sql(f"select {', '.join(chr(34) + c + chr(34) for c in names)} from ({catalog.oracle_sql()[name]})").fetchall()
    assert mine == sorted(map(str, theirs)) and mine


#: Around the first turns of 33 bits at 90,000 and at 27,000 ticks an event, and far beyond; gaps are longer than a turn.
IDS = [0, 1, 95_443, 95_444, 318_144, 318_145, 1_336_000, 36_000_000, 2_000_000_003]


def test_time_stamps_of_any_turn(spark, tmp_path):
    equal(spark, tmp_path, "elementary_packets", [(i, 7 * k, "click" if k % 2 else "purchase") for k, i in enumerate(IDS)])


def test_clock_references_of_any_turn(spark, tmp_path):
    equal(spark, tmp_path, "packet_clocks", [(i, k, "click") for k, i in enumerate(IDS)])


def test_hardware_addresses_of_any_user(spark, tmp_path):
    equal(spark, tmp_path, "pcap_headers", [(k, u, t) for k, (u, t) in enumerate([(1, "click"), (65_535, "view"), (65_536, "click"), (89_999, "signup"), (12_345_678, "error")])])


def test_names_of_any_user(spark, tmp_path):
    equal(spark, tmp_path, "pcapng_names", [(k, u, "click") for k, u in enumerate([0, 255, 256, 65_535, 65_536, 89_999, 16_777_215])])
