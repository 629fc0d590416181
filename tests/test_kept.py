"""Relations of containers grow with the files, so that no join sends one through the driver."""

import pytest

import __spark_entry__ as entry
from cinequery.operators import container, settle
from cinequery.operators.demux import open_container
from cinequery.plans import demux_queries
from cinequery.sources import containers as S

NAMES = ["set_items", "tracks", "composition_tracks", "source_clips", "packet_build", "codec_select", "container_faults"]
#: Of tables alone, whose size Spark knows, and of the 20 profiles.
SMALL = ("[k#", "[header_cid#")
OPENED = []


def broadcasts(df):
    """The broadcast joins that Spark plans of what it takes for the sizes of ``df``'s parts."""
    lines = df._jdf.queryExecution().sparkPlan().toString().splitlines()
    return [line for line in lines if "Broadcast" in line and not any(s in line for s in SMALL)]


@pytest.mark.parametrize("name", NAMES)
def test_no_relation_is_broadcast(spark, sf_dir, monkeypatch, name):
    found, write = [], settle.settled

    def recorded(df):
        found.extend(broadcasts(df))
        return write(df)

    monkeypatch.setattr(settle, "settled", recorded)
    monkeypatch.setattr(container, "settled", recorded)
    if not OPENED:
        OPENED.append(open_container(S.containers(spark, sf_dir)))
    monkeypatch.setattr(demux_queries, "opened", lambda *_: OPENED[0])
    assert found + broadcasts(entry.queries()[name](spark, sf_dir)) == []
