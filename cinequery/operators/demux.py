"""A container's relations from one scan: partitions, sets, descriptors, tracks, compositions, timecode, index and packets.

``open_container`` scans files once and keeps their triplets, with the values of metadata, in the
checkpoint folder. Everything else is joins and windows over these, keyed by file; within a file
the groups are bounded by LIMITS. Faults are rows of ``faults``, never exceptions.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinequery.functions import header as H
from cinequery.functions.binary import be_uint, cut
from cinequery.operators import container as C
from cinequery.operators import index as I
from cinequery.operators import klv, validate
from cinequery.operators.settle import kept

FILE = ("file",)
TRACK_TYPES = ("Track", "StaticTrack")


def open_container(files: DataFrame) -> Container:
    """The container relations of files (file, payload); null payloads have none."""
    return Container(klv.scan(files, with_contents=True))


def open_path(spark: SparkSession, path: str, **options: str) -> Container:
    """The same of files at a path (several: by commas), read by position: only keys, lengths and metadata."""
    from cinequery.sources import media

    media.register(spark)
    return Container(spark.read.format("klv").options(contents="true", **options).load(path))


def _first(by: list[str], order: list[Column | str], rows: DataFrame) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("turn", F.row_number().over(w)).where("turn = 1").drop("turn")


def _last(by: list[str], rows: DataFrame) -> DataFrame:
    """Of each key the row that comes last in the file."""
    return _first(by, [F.desc("offset")], rows.dropna(subset=by))


class Container:
    """Relations over all files scanned; each has a column ``file``."""

    def __init__(self, triplets: DataFrame):
        self.triplets = kept(triplets)

    @cached_property
    def partitions(self) -> DataFrame:
        """The fields of each partition pack, its kind, status and offset."""
        packs = self.triplets.where((C.key_class("key_hex") == "partition") & F.col("value").isNotNull())
        code = lambda at: F.conv(F.substring("key_hex", at, 2), 16, 10).cast("int")
        rows = packs.select("file", "offset", C.partition_kind(code(27)).alias("kind"), code(29).alias("status"), F.explode(F.array(C.partition_pack("value"))).alias("p"))
        return rows.where("p IS NOT NULL").select("file", "offset", "kind", "status", "p.*")

    @cached_property
    def patterns(self) -> DataFrame:
        """Of each file the operational pattern of its first partition: label, and op1a, opatom or null."""
        first = _first(["file"], ["offset"], self.partitions)
        return first.select("file", F.col("operational_pattern").alias("label"), C.operational_pattern("operational_pattern").alias("pattern"))

    @cached_property
    def _primer_entries(self) -> DataFrame:
        packs = self.triplets.where((F.col("key_hex") == klv.PRIMER_KEY) & F.col("value").isNotNull())
        return packs.select("file", "offset", F.posexplode(C.primer_entries("value")).alias("pos", "e")).select("file", "offset", "pos", "e.tag", "e.label")

    @cached_property
    def primer(self) -> DataFrame:
        """tag and label; of a tag given several times the last."""
        return self._primer_entries.groupBy("file", "tag").agg(F.max_by("label", F.struct("offset", "pos")).alias("label"))

    @cached_property
    def sets(self) -> DataFrame:
        """offset, type, instance_uid and items of the sets of known type whose items fit."""
        typed = self.triplets.where("items IS NOT NULL").withColumn("type", C.set_type("key_hex")).where("type IS NOT NULL")
        return typed.select("file", "offset", "key_hex", "type", C.item_uid("items", 0x3C0A).alias("instance_uid"), "items")

    @cached_property
    def items(self) -> DataFrame:
        """Each item of each set with the label that the primers before the set give its tag."""
        own = self.sets.select("file", "offset", F.posexplode("items").alias("pos", "i")).select("file", "offset", "pos", F.col("i.tag").alias("tag"), F.col("i.value").alias("value"), F.lit(None).cast("string").alias("named"), F.lit(1).alias("side"))
        given = self._primer_entries.select("file", "offset", "pos", "tag", F.lit(None).cast("binary").alias("value"), F.col("label").alias("named"), F.lit(0).alias("side"))
        w = Window.partitionBy("file", "tag").orderBy("offset", "side", "pos").rowsBetween(Window.unboundedPreceding, 0)
        return own.unionByName(given).withColumn("label", F.last("named", True).over(w)).where("side = 1").select("file", "offset", "pos", "tag", "label", "value")

    @cached_property
    def _properties(self) -> DataFrame:
        """``properties``, and whether a set is the last of those with its instance_uid."""
        i = "items"
        fields = {
            "package_uid": C.item_hex(i, 0x4401), "package_name": C.item_string(i, 0x4402), "tracks": C.item_references(i, 0x4403), "descriptor_uid": C.item_uid(i, 0x4701), "descriptors": C.item_references(i, 0x3F01),
            "linked_package": C.item_hex(i, 0x2701), "sid": C.item_u32(i, 0x3F07),
            "track_id": C.item_u32(i, 0x4801), "number": be_uint(C.item(i, 0x4804), 0, 4), "rate": C.item_rational(i, 0x4B01), "origin": C.item_i64(i, 0x4B02), "name": C.item_string(i, 0x4802), "sequence_uid": C.item_uid(i, 0x4803),
            "data_definition": C.item_hex(i, 0x0201), "duration": C.item_i64(i, 0x0202), "components": C.item_references(i, 0x1001),
            "clip_package": C.item_hex(i, 0x1101), "clip_track": C.item_u32(i, 0x1102), "clip_start": C.item_i64(i, 0x1201),
            "start_timecode": C.item_i64(i, 0x1501), "timecode_base": C.item_u16(i, 0x1502), "drop_frame": be_uint(C.item(i, 0x1503), 0, 1) != 0,
        }
        rows = self.sets.select("file", "offset", "type", "instance_uid", *(c.alias(n) for n, c in fields.items()))
        turn = F.row_number().over(Window.partitionBy("file", "instance_uid").orderBy(F.desc("offset")))
        return kept(rows.withColumn("is_last", F.col("instance_uid").isNotNull() & (turn == 1)))

    @cached_property
    def properties(self) -> DataFrame:
        """One row a set with the items that the relations below are joined by, without other values."""
        return self._properties.drop("is_last")

    @cached_property
    def _by_uid(self) -> DataFrame:
        """Of sets with one instance_uid the last."""
        return self._properties.where("is_last").drop("is_last")

    def _referred(self, *columns: str, types: tuple[str, ...], prefix: str) -> DataFrame:
        """Sets by their instance_uid as ``<prefix>uid``, their columns with the prefix."""
        return self._by_uid.where(F.col("type").isin(*types)).select("file", F.col("instance_uid").alias(f"{prefix}uid"), *(F.col(c).alias(f"{prefix}{c}") for c in columns))

    @cached_property
    def descriptors(self) -> DataFrame:
        """instance_uid and the other fields of the sets whose type ends with Descriptor."""
        rows = self.sets.where(F.endswith(F.col("type"), F.lit("Descriptor")))
        return rows.select("file", "offset", "type", "instance_uid", F.explode(F.array(C.descriptor("items"))).alias("d")).select("file", "offset", "type", "instance_uid", "d.*")

    @cached_property
    def essence(self) -> DataFrame:
        """Each essence element: ord, track number and kind of item, body_sid of its partition, ordinal in its track."""
        rows = self.triplets.where(C.key_class("key_hex") == "essence")
        part = lambda at, n: F.conv(F.substring("key_hex", at, n), 16, 10)
        return rows.select(
            "file", "ord", "offset", "body_sid", part(25, 8).cast("long").alias("number"), part(25, 2).cast("int").alias("item_type"), part(27, 2).cast("int").alias("element_count"),
            part(29, 2).cast("int").alias("element_type"), part(31, 2).cast("int").alias("element_number"), "element", "value_offset", "value_length", F.col("value").alias("head"),
        )

    @cached_property
    def index_segments(self) -> DataFrame:
        """Index table segments with their entries: null entries don't fit their array."""
        i = "items"
        array = C.item(i, 0x3F0A)
        fields = {
            "rate": C.item_rational(i, 0x3F0B), "start": F.coalesce(C.item_i64(i, 0x3F0C), F.lit(0).cast("long")), "duration": F.coalesce(C.item_i64(i, 0x3F0D), F.lit(0).cast("long")),
            "unit_bytes": F.coalesce(C.item_u32(i, 0x3F05), F.lit(0).cast("long")), "index_sid": F.coalesce(C.item_u32(i, 0x3F06), F.lit(0).cast("long")), "body_sid": F.coalesce(C.item_u32(i, 0x3F07), F.lit(0).cast("long")),
            "entries": F.when(array.isNull(), F.array()).when(F.octet_length(array) >= 8, C.index_entries(array)),
        }
        rows = self.sets.where("type = 'IndexTableSegment'").select("file", "offset", *(c.alias(n) for n, c in fields.items()))
        rows = rows.withColumn("n_entries", F.coalesce(F.size("entries"), F.lit(0)).cast("long"))
        return kept(rows.withColumn("length", I.segment_length()))

    @cached_property
    def random_index(self) -> DataFrame:
        """body_sid and byte_offset of each row of a file's last random index whose length fits."""
        fits = (F.octet_length("value") >= 4) & ((F.octet_length("value") - 4) % 12 == 0)
        last = _last(["file"], self.triplets.where((F.col("key_hex") == klv.RANDOM_INDEX_KEY) & fits))
        return last.select("file", F.posexplode(C.random_index("value")).alias("pos", "e")).select("file", "pos", "e.body_sid", "e.byte_offset")

    @cached_property
    def track_links(self) -> DataFrame:
        """What container data says of a track set: body_sid, package and the descriptors that may describe it. Of several links the last counts."""
        data = self.properties.where("type = 'EssenceContainerData' AND sid > 0").select("file", F.col("offset").alias("at"), F.col("linked_package").alias("package_uid"), F.col("sid").alias("linked_sid"))
        packages = _last(["file", "package_uid"], self.properties.where("type = 'SourcePackage'")).select("file", "package_uid", F.col("instance_uid").alias("package_instance_uid"), "tracks", "descriptor_uid")
        linked = data.join(packages, ["file", "package_uid"])
        tracks = linked.select("file", "at", "linked_sid", "package_uid", "package_instance_uid", "descriptor_uid", F.posexplode("tracks").alias("pos", "instance_uid"))
        last = tracks.groupBy("file", "instance_uid").agg(F.max_by(F.struct("linked_sid", "package_uid", "package_instance_uid", "descriptor_uid"), F.struct("at", "pos")).alias("l")).select("file", "instance_uid", "l.*")
        return last.join(self.package_descriptors, ["file", "descriptor_uid"], "left").withColumn("allowed", F.coalesce("allowed", F.array().cast("array<string>")))

    @cached_property
    def package_descriptors(self) -> DataFrame:
        """allowed: a package's root descriptor and, if that is a multiple one, those it holds."""
        roots = self.properties.where("type = 'SourcePackage' AND descriptor_uid IS NOT NULL").select("file", "descriptor_uid").distinct()
        parts = self._referred("descriptors", types=("MultipleDescriptor",), prefix="").withColumnRenamed("uid", "descriptor_uid")
        root = F.array("descriptor_uid")
        return roots.join(parts, ["file", "descriptor_uid"], "left").select("file", "descriptor_uid", F.array_union(root, F.coalesce("descriptors", F.array().cast("array<string>"))).alias("allowed")).hint("merge")

    @cached_property
    def track_sets(self) -> DataFrame:
        """Track sets with an id, a number and a rate, their links, their sequence's duration, and the first descriptor that describes them."""
        sets = self.properties.where(F.col("type").isin(*TRACK_TYPES)).where("track_id IS NOT NULL AND number IS NOT NULL AND rate IS NOT NULL")
        sets = sets.select("file", F.col("offset").alias("set_ord"), "instance_uid", "track_id", "number", "rate", F.coalesce("origin", F.lit(0).cast("long")).alias("origin"), "name", "sequence_uid")
        sequences = _last(["file", "instance_uid"], self.properties.where("type = 'Sequence'")).select("file", F.col("instance_uid").alias("sequence_uid"), "duration")
        linked = kept(sets.join(self.track_links, ["file", "instance_uid"], "left").join(sequences, ["file", "sequence_uid"], "left"))
        d = self.descriptors.where("linked_track_id IS NOT NULL").select("file", F.col("linked_track_id").alias("track_id"), F.col("offset").alias("d_at"), F.col("instance_uid").alias("d_uid"))
        may = F.col("allowed").isNull() | F.array_contains("allowed", F.col("d_uid"))
        described = linked.select("file", "set_ord", "track_id", "allowed").join(d, ["file", "track_id"]).where(may).groupBy("file", "set_ord").agg(F.min("d_at").alias("descriptor_offset"))
        return kept(linked.join(described, ["file", "set_ord"], "left").withColumn("has_descriptor", F.col("descriptor_offset").isNotNull()))

    @cached_property
    def tracks(self) -> DataFrame:
        """A track for each (body_sid, number) with essence: of its track set, or made up where there is none. track_ord is its place in the file's list; ``descriptors`` has its fields at descriptor_offset."""
        found = C.preferred(C.match_tracks(self.track_sets, self.essence, FILE), FILE).withColumns({"rate_num": F.col("rate.num"), "rate_den": F.col("rate.den"), "synthetic": F.lit(False)})
        rest = C.synthetic_tracks(self.essence, found, FILE).withColumns({"place": F.col("first_ord"), "synthetic": F.lit(True), "origin": F.lit(0).cast("long"), **{c: F.col(c).cast("long") for c in ("rate_num", "rate_den")}})
        rows = found.unionByName(rest, allowMissingColumns=True).withColumn("kind", C.essence_kind("item_type"))
        order = Window.partitionBy("file").orderBy("synthetic", "place", "first_ord")
        columns = ["track_id", "number", "kind", "name", "rate_num", "rate_den", "origin", "duration", "sequence_uid", "descriptor_offset", "packet_count", "package_uid", "package_instance_uid", "synthetic"]
        return kept(rows.select("file", F.row_number().over(order).alias("track_ord"), "body_sid", *columns))

    @cached_property
    def composition_tracks(self) -> DataFrame:
        """Tracks of material packages with a sequence: package, place among its references, kind of the first clip whose source is known, or of the data definition."""
        packages = self.properties.where("type = 'MaterialPackage'").select("file", F.col("offset").alias("package_at"), "package_uid", F.col("instance_uid").alias("package_instance_uid"), "package_name", F.posexplode("tracks").alias("track_pos", "t_uid"))
        tracks = self._referred("track_id", "number", "rate", "origin", "name", "sequence_uid", types=TRACK_TYPES, prefix="t_").where("t_track_id IS NOT NULL AND t_rate IS NOT NULL")
        sequences = self._referred("data_definition", "duration", types=("Sequence",), prefix="s_")
        rows = packages.join(tracks, ["file", "t_uid"]).join(sequences.withColumnRenamed("s_uid", "t_sequence_uid"), ["file", "t_sequence_uid"])
        rows = rows.select(
            "file", "package_at", "package_uid", "package_instance_uid", "package_name", "track_pos", F.col("t_track_id").alias("track_id"), F.col("t_number").alias("number"), F.col("t_name").alias("name"), F.col("t_rate.num").alias("rate_num"), F.col("t_rate.den").alias("rate_den"),
            F.coalesce("t_origin", F.lit(0).cast("long")).alias("origin"), F.col("s_duration").alias("duration"), F.col("t_sequence_uid").alias("sequence_uid"), F.col("s_data_definition").alias("data_definition"),
        )
        return kept(rows)

    @cached_property
    def _flat(self) -> DataFrame:
        """The source clips under each composition's sequence in order; a leaf of null where a sequence holds itself."""
        key = lambda c: F.concat_ws("/", F.col("file").cast("string"), F.col(c))
        children = self._referred("type", types=("SourceClip", "Sequence"), prefix="c_")
        graph = self._by_uid.where("type = 'Sequence'").select("file", "instance_uid", F.posexplode("components").alias("pos", "c_uid")).join(children, ["file", "c_uid"])
        graph = graph.select(key("instance_uid").alias("parent"), "pos", key("c_uid").alias("child"), (F.col("c_type") == "SourceClip").alias("is_leaf"))
        roots = self.composition_tracks.select("file", "sequence_uid").distinct().withColumn("root", key("sequence_uid"))
        flat = C.flatten(graph.hint("merge"), roots.select("root")).join(roots, "root")
        return kept(flat.select("file", "sequence_uid", F.element_at(F.split("leaf", "/"), -1).alias("clip_uid"), "path"))

    @cached_property
    def source_clips(self) -> DataFrame:
        """The clips of each composition track in order, with the track of the source package that each shows, if there is one."""
        clips = self._referred("data_definition", "duration", "clip_start", "clip_package", "clip_track", types=("SourceClip",), prefix="c_").withColumnRenamed("c_uid", "clip_uid")
        known = F.when(~F.col("c_clip_package").rlike("^0+$"), F.col("c_clip_package"))
        order = Window.partitionBy("file", "package_at", "track_pos").orderBy("path")
        rows = self.composition_tracks.select("file", "package_at", "track_pos", "sequence_uid").join(self._flat.where("clip_uid IS NOT NULL"), ["file", "sequence_uid"])
        rows = rows.withColumn("clip_pos", F.row_number().over(order) - 1).join(clips, ["file", "clip_uid"]).withColumn("source_package", known)
        source = _first(["file", "package_uid", "track_id"], ["track_ord"], self.tracks.where("package_uid IS NOT NULL")).select("file", F.col("package_uid").alias("source_package"), F.col("track_id").alias("c_clip_track"), F.col("track_ord").alias("source_track"), F.col("kind").alias("source_kind"))
        met = rows.join(source, ["file", "source_package", "c_clip_track"], "left")
        return met.select("file", "package_at", "track_pos", "clip_pos", "clip_uid", F.col("c_data_definition").alias("data_definition"), F.col("c_duration").alias("duration"), F.coalesce("c_clip_start", F.lit(0).cast("long")).alias("start_position"), "source_package", F.col("c_clip_track").alias("source_track_id"), "source_track", "source_kind")

    @cached_property
    def compositions(self) -> DataFrame:
        """One row a material package with its tracks, and in them their clips, as nested arrays; a file's sets, and so these, are bounded by LIMITS."""
        ordered = lambda *c: F.transform(F.array_sort(F.collect_list(F.struct(c[0], F.struct(*c).alias("row")))), lambda x: x["row"])
        clips = self.source_clips.groupBy("file", "package_at", "track_pos").agg(ordered("clip_pos", "clip_uid", "duration", "start_position", "source_package", "source_track_id", "source_track").alias("clips"), F.min_by("source_kind", F.when(F.col("source_kind").isNotNull(), F.col("clip_pos"))).alias("source_kind"))
        kind = F.coalesce("source_kind", C.data_definition_kind("data_definition"))
        tracks = self.composition_tracks.join(clips, ["file", "package_at", "track_pos"], "left").withColumns({"kind": kind, "clips": F.coalesce("clips", F.array())})
        tracks = tracks.groupBy("file", "package_at").agg(ordered("track_pos", "track_id", "number", "name", "kind", "rate_num", "rate_den", "origin", "duration", "sequence_uid", "clips").alias("tracks"))
        packages = self.properties.where("type = 'MaterialPackage'").select("file", F.col("offset").alias("package_at"), "package_uid", F.col("instance_uid").alias("package_instance_uid"), F.col("package_name").alias("name"))
        return packages.join(tracks, ["file", "package_at"], "left").withColumn("tracks", F.coalesce("tracks", F.array()))

    @cached_property
    def timecode_tracks(self) -> DataFrame:
        """Tracks of material and source packages whose sequence holds a timecode component, the first one's numbers."""
        packages = self.properties.where("type IN ('MaterialPackage', 'SourcePackage')").select("file", F.col("offset").alias("package_at"), F.when(F.col("type") == "MaterialPackage", "material").otherwise("source").alias("package_kind"), "package_uid", F.posexplode("tracks").alias("track_pos", "t_uid"))
        tracks = self._referred("track_id", "rate", "origin", "name", "sequence_uid", types=TRACK_TYPES, prefix="t_").where("t_track_id IS NOT NULL AND t_rate IS NOT NULL").withColumnRenamed("t_sequence_uid", "s_uid")
        sequences = self._by_uid.where("type = 'Sequence'").select("file", F.col("instance_uid").alias("s_uid"), F.col("duration").alias("s_duration"), F.posexplode("components").alias("pos", "c_uid"))
        parts = self._referred("duration", "start_timecode", "timecode_base", "drop_frame", types=("TimecodeComponent",), prefix="c_")
        rows = packages.join(tracks, ["file", "t_uid"]).join(sequences.join(parts, ["file", "c_uid"]).hint("merge"), ["file", "s_uid"])
        first = _first(["file", "package_at", "track_pos"], ["pos"], rows).where("c_start_timecode IS NOT NULL AND c_timecode_base IS NOT NULL AND c_drop_frame IS NOT NULL")
        return first.select(
            "file", "package_at", "track_pos", "package_kind", "package_uid", F.col("t_track_id").alias("track_id"), F.col("t_name").alias("name"), F.col("t_rate.num").alias("rate_num"), F.col("t_rate.den").alias("rate_den"), F.coalesce("t_origin", F.lit(0).cast("long")).alias("origin"),
            F.coalesce("s_duration", "c_duration").alias("duration"), F.col("c_start_timecode").alias("start_timecode"), F.col("c_timecode_base").alias("timecode_base"), F.col("c_drop_frame").alias("drop_frame"),
        )

    @cached_property
    def bodies(self) -> DataFrame:
        """What the index says of each body: its one unit size, the positions indexed, entries, and whether its segments follow on each other."""
        return I.bodies(self.index_segments, FILE).hint("merge")

    @cached_property
    def slices(self) -> DataFrame:
        """Each essence element cut as the index says: by unit size, at the entries of a clip's only element, or whole. Elements that can't be cut so are faults and have no slice."""
        counts = C.track_groups(self.essence, FILE).select("file", *C.TRACK, F.col("packet_count").alias("elements"))
        rows = self.essence.select("file", "ord", *C.TRACK, "value_offset", "value_length").join(counts, ["file", *C.TRACK]).join(self.bodies, ["file", "body_sid"], "left")
        how = I.slice_kind(F.coalesce("unit", F.lit(0)), "value_length", "elements", F.coalesce("n_entries", F.lit(0)))
        return I.element_slices(kept(rows.withColumn("how", how)), I.body_entries(self.index_segments, FILE), FILE)

    @cached_property
    def _reach(self) -> DataFrame:
        """The positions that each index segment covers, of those that a packet can have."""
        past = F.least(F.coalesce(F.expr("try_add(start, length)"), F.lit(C.LIMITS["packets"])), F.lit(C.LIMITS["packets"]))
        rows = self.index_segments.select("file", "body_sid", F.greatest("start", F.lit(0).cast("long")).alias("start"), past.alias("past"), F.col("offset").alias("segment"))
        return rows.select("file", "body_sid", "start", (F.col("past") - F.col("start")).alias("length"), "segment")

    @cached_property
    def packets(self) -> DataFrame:
        """The packets of all tracks: place in the track, times, keyframe (null where no entry says), and where the bytes are."""
        order = Window.partitionBy("file", *C.TRACK).orderBy("ord", "slice")
        rows = self.slices.withColumn("packet_index", F.row_number().over(order).cast("long") - 1)
        rows = kept(rows.join(self.tracks.select("file", "track_ord", *C.TRACK, "rate_num", "rate_den", "origin"), ["file", *C.TRACK]))
        position = rows.select("file", "body_sid", F.col("packet_index").alias("position")).distinct().withColumn("id", F.col("position"))
        at = I.at_position(position, self._reach, by=FILE)
        entries = self.index_segments.select("file", F.col("offset").alias("segment"), "start", F.posexplode("entries").alias("pos", "e")).select("file", "segment", F.expr("try_add(start, CAST(pos AS BIGINT))").alias("position"), "e.flags")
        flags = at.where("covering = 1").join(entries, ["file", "segment", "position"]).select("file", "body_sid", F.col("position").alias("packet_index"), "flags")
        rows = rows.join(flags, ["file", "body_sid", "packet_index"], "left").withColumns(C.timing("packet_index", "origin", "rate_num", "rate_den"))
        keyframe = F.col("flags").bitwiseAND(F.lit(0x80)) != 0
        return rows.select("file", "track_ord", *C.TRACK, "packet_index", "timestamp", "duration", "timestamp_us", "duration_us", keyframe.alias("keyframe"), (F.col("value_offset") + F.col("slice_offset")).alias("byte_offset"), F.col("slice_length").alias("byte_length"), "ord")

    @cached_property
    def selection(self) -> DataFrame:
        """Of each file the video track that a frame decoder takes, or why none: pattern, one track in an atom, a composition, a first packet with a frame header, a clip that shows it."""
        tracks = self.tracks.where("packet_count > 0").groupBy("file").agg(F.count("*").alias("n_tracks"))
        made = self.properties.where("type = 'MaterialPackage'").select("file").distinct().withColumn("composed", F.lit(True))
        first = self.packets.where("packet_index = 0").select("file", "track_ord", "byte_length")
        heads = self.essence.where("element = 0").select("file", *C.TRACK, "head")
        video = self.tracks.where("kind = 'video'").join(first, ["file", "track_ord"]).join(heads, ["file", *C.TRACK]).select("file", "track_ord", "track_id", "byte_length", cut("head", 0, F.least("byte_length", F.lit(H.HEADER_BYTES))).alias("packet"))
        parsed = H.parse(video, declared_length="byte_length").where("ok").select("file", "track_ord", "track_id", "profile", "supported")
        shown = self.source_clips.where("source_track IS NOT NULL").select("file", F.col("source_track").alias("track_ord")).distinct().withColumn("shown", F.lit(True)).hint("merge")
        chosen = _first(["file"], ["track_ord"], parsed).join(shown, ["file", "track_ord"], "left").hint("merge")
        rows = self.triplets.select("file").distinct().join(self.patterns, "file", "left").join(tracks, "file", "left").join(made, "file", "left").join(chosen, "file", "left")
        outcome = (
            F.when(F.col("pattern").isNull(), "unsupported pattern").when((F.col("pattern") == "opatom") & (F.coalesce("n_tracks", F.lit(0)) != 1), "track count").when(F.col("composed").isNull(), "no composition")
            .when(F.col("track_ord").isNull(), "no frame").when(F.col("shown").isNull(), "not referenced").otherwise("ok")
        )
        return rows.select("file", "pattern", outcome.alias("outcome"), *(F.when(outcome == "ok", F.col(c)).alias(c) for c in ("track_ord", "track_id", "profile", "supported")))

    @cached_property
    def limits(self) -> DataFrame:
        """(file, what, n) of the rows that a file has more of than LIMITS allows."""
        count = lambda what, rows: rows.groupBy("file").agg(F.count("*").alias("n")).select("file", F.lit(what).alias("what"), "n")
        listed = self.tracks.select("file").unionByName(self.timecode_tracks.select("file")).unionByName(self.composition_tracks.select("file"))
        parts = [count("klv_packets", self.triplets.where("error IS NULL")), count("metadata_sets", self.sets), count("tracks", listed), count("packets", self.packets)]
        return C.limit_failures(reduce(DataFrame.unionByName, parts))

    @cached_property
    def faults(self) -> DataFrame:
        """(file, rule, offset) of all that is wrong with the files' structure."""
        rule = lambda name, rows: rows.select("file", F.lit(name).alias("rule"), "offset")
        packs = self.triplets.where(F.col("value").isNotNull())
        rip = packs.where((F.col("key_hex") == klv.RANDOM_INDEX_KEY) & ((F.octet_length("value") < 4) | ((F.octet_length("value") - 4) % 12 != 0)))
        position = self.packets.select("file", "body_sid", F.col("packet_index").alias("position"), "ord").join(self.essence.select("file", "ord", "offset"), ["file", "ord"])
        covered = I.at_position(position.groupBy("file", "body_sid", "position").agg(F.min("offset").alias("id")), self._reach, by=FILE)
        cut_wrong = self.essence.select("file", "ord", "offset").join(self.slices.select("file", "ord").distinct(), ["file", "ord"], "left_anti")
        wide = self.descriptors.where("width > 16384 OR height > 16384 OR coalesce(width, 0) * coalesce(height, 0) > 268435456")
        cycles = self._flat.where("clip_uid IS NULL").select("file", F.col("sequence_uid").alias("instance_uid")).distinct().join(self._by_uid.select("file", "instance_uid", "offset"), ["file", "instance_uid"])
        parts = [
            self.triplets.where("error IS NOT NULL").select("file", F.col("error").alias("rule"), "offset"),
            rule("primer", packs.where((F.col("key_hex") == klv.PRIMER_KEY) & C.primer_entries("value").isNull())),
            rule("random index length", rip),
            rule("index entries", self.index_segments.where("entries IS NULL")),
            rule("index positions covered twice", covered.where("covering > 1").select("file", F.col("id").alias("offset"))),
            rule("element cannot be cut", cut_wrong),
            rule("frame dimensions", wide),
            rule("sequence cycle", cycles),
            validate.faults(self.partitions, self.index_segments.select("file", "offset", "index_sid", "body_sid"), self.random_index),
        ]
        return reduce(DataFrame.unionByName, parts)
