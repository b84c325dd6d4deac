"""Settings of every metro: the build's defaults under the metro's override."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.functions.text import metro_slug
from meshloom.operators.audits import issues


def override_slugs(metros: DataFrame, slugs: DataFrame) -> DataFrame:
    """``metros`` with ``slug``: that of ``slugs`` which is the slug of the metro's name, else of its original name, else null."""
    known = slugs.select("slug").distinct()
    rows = metros.withColumn("_own", metro_slug(F.col("name"))).withColumn("_orig", metro_slug(F.coalesce("name_orig", "name")))
    rows = rows.join(known.toDF("_by_name"), F.col("_own") == F.col("_by_name"), "left").join(known.toDF("_by_orig"), F.col("_orig") == F.col("_by_orig"), "left")
    return rows.withColumn("slug", F.coalesce("_by_name", "_by_orig")).drop("_own", "_orig", "_by_name", "_by_orig")


def unknown_overrides(metros: DataFrame, slugs: DataFrame) -> DataFrame:
    """Slugs of overrides that no metro has, by either of its names."""
    own = metros.select(F.explode(F.array(metro_slug(F.col("name")), metro_slug(F.coalesce("name_orig", "name")))).alias("slug"))
    return slugs.select("slug").distinct().join(own, "slug", "left_anti")


def metro_settings(metros: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """``(metro_idx, name, pops, site_blueprint, dcs, dc_blueprint)`` of every metro, from :func:`meshloom.config.build_tables`."""
    over = tables["site_overrides"]
    fields = [c for c in over.columns if c != "slug"]
    rows = override_slugs(metros, over).select("metro_idx", "name", "slug").join(over.select("slug", *[F.col(c).alias(f"_{c}") for c in fields]), "slug", "left")
    rows = rows.join(F.broadcast(tables["sites"]), F.lit(True))  # one row
    return rows.select("metro_idx", "name", *[F.coalesce(f"_{c}", c).alias(c) for c in fields])


def link_settings(metros: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """One row for each metro and link family; ``attrs`` of an override are put over the default's, its other values replace them."""
    over = tables["link_overrides"]
    fields = [c for c in over.columns if c not in ("slug", "family")]
    own = override_slugs(metros, tables["site_overrides"].select("slug")).select("metro_idx", "name", "slug")
    rows = own.join(F.broadcast(tables["links"]), F.lit(True))  # three rows
    rows = rows.join(over.select("slug", "family", *[F.col(c).alias(f"_{c}") for c in fields]), ["slug", "family"], "left")
    kept = F.map_filter("attrs", lambda k, v: ~F.coalesce(F.map_contains_key("_attrs", k), F.lit(False)))
    merged = F.when(F.col("_attrs").isNull(), F.col("attrs")).otherwise(F.map_concat(kept, "_attrs"))
    return rows.select("metro_idx", "name", "family", *[(merged if c == "attrs" else F.coalesce(f"_{c}", c)).alias(c) for c in fields])


def problems(sites: DataFrame, links: DataFrame) -> DataFrame:
    """Issues of settings out of range: sites, capacities above 0, costs of 0 or more (within a metro above 0)."""
    bad_sites = sites.select("name", F.explode(F.array(F.when(F.col("pops") < 1, F.lit("no point of presence")), F.when(F.col("dcs") < 0, F.lit("negative data centres")))).alias("m"))
    low = F.col("cost") < F.when(F.col("family") == "intra_metro_link", 1).otherwise(0)
    bad_links = links.select("name", F.explode(F.array(
        F.when(F.col("capacity") <= 0, F.concat("family", F.lit(" capacity"))), F.when(low, F.concat("family", F.lit(" cost")))
    )).alias("m"))
    return issues(bad_sites.union(bad_links).where("m IS NOT NULL"), "settings", "name", F.col("m"))
