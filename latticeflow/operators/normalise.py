"""Sweep rows from run profiles of many ages (F18, F19): paths are tried in order, the first value counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a field of a sweep row may stand in a profile, in order of preference.
PATHS = {
    "k_sq": ("radii.k_sq", "k_sq"),
    "r_inner": ("radii.r_inner", "r_inner"),
    "r_outer": ("radii.r_outer", "r_outer"),
    "region": ("region", "radii.region"),
    "verdict": ("verdict",),
    "telemetry_level": ("telemetry_level", "stats_level", "stats_v2.telemetry_level"),
    "schema_version": ("schema_version",),
    "commit": ("commit", "git_commit", "build.commit"),
    "build_id": ("build_id", "build_identity", "build.id"),
    "cuda_arch": ("cuda_arch", "build.cuda_arch", "device.cuda_arch"),
    "active_tiles": ("tiles.active", "active_tiles"),
    "produced_tiles": ("tiles.produced", "produced_tiles"),
    "ingested_tiles": ("tiles.ingested", "ingested_tiles"),
    "early_exit_enabled": ("early_exit_enabled",),
    "early_exit_taken": ("early_exit_taken",),
    "bz_checked": ("bz.checked", "bz_checked"),
    "bz_clean": ("bz.clean", "bz.bz_clean", "bz_clean"),
    "bz_override_used": ("bz.override_used", "bz.override", "bz_override_used"),
    "bz_bad_norm_count": ("bz.bad_norm_count", "bz_bad_norm_count"),
    "emitted_overflow_bit_count": ("host_tileop_counters.emitted_overflow_bit_count",),
    "geo_i_tiles": ("stats_v2.geo_i_tiles",),
    "geo_o_tiles": ("stats_v2.geo_o_tiles",),
    "geo_i_ports": ("stats_v2.geo_i_ports", "stats_v2.geo_I.port_population"),
    "geo_o_ports": ("stats_v2.geo_o_ports", "stats_v2.geo_O.port_population"),
    "component_census": ("stats_v2.component_census", "stats_v2.components.census", "stats_v2.component.census"),
    "sample_manifest_path": ("stats_v2.sample_manifest_path",),
    "tile_sample_path": ("stats_v2.tile_sample_path",),
    "sample_count": ("stats_v2.sample_count", "stats_v2.tile_sample_count", "stats_v2.tile_samples_written"),
    "snapshot_path": ("stats_v2.snapshot_path",),
    "snapshot_sha256": ("stats_v2.snapshot_sha256",),
    "total_seconds": ("timings_seconds.total", "total_seconds", "total_time_seconds", "timing.total_seconds"),
    "cuda_k1_k5_seconds": ("timings_seconds.cuda_k1_k5", "cuda_k1_k5_seconds", "timing.cuda_k1_k5_seconds"),
    "compositor_seconds": ("timings_seconds.compositor", "compositor_seconds", "timing.compositor_seconds"),
}
WHOLE = ("k_sq", "r_inner", "r_outer", "active_tiles", "produced_tiles", "ingested_tiles", "bz_bad_norm_count", "emitted_overflow_bit_count", "geo_i_tiles", "geo_o_tiles", "geo_i_ports", "geo_o_ports", "sample_count")
REAL = ("total_seconds", "cuda_k1_k5_seconds", "compositor_seconds")
TRUTH = ("early_exit_enabled", "early_exit_taken", "bz_checked", "bz_clean", "bz_override_used")
DISTRIBUTIONS = {
    "candidate_count_distribution": ("candidate_count_distribution", "candidate_count", "candidate_counts", "candidates"),
    "gaussian_prime_count_distribution": ("gaussian_prime_count_distribution", "prime_count_distribution", "gaussian_prime_count", "gaussian_prime_counts", "prime_counts"),
    "group_count_distribution": ("group_count_distribution", "group_count", "group_counts", "groups"),
    "total_port_count_distribution": ("total_port_count_distribution", "port_count_distribution", "total_port_count", "total_port_counts", "port_counts"),
    "max_face_port_count_distribution": ("max_face_port_count_distribution", "max_face_port_count", "max_face_port_counts"),
}
POSTFLIGHT = ["REJECT", "RUN_CONTRACT_PASS", "TILE_SAMPLE_AUDIT_PASS", "SPAN_PROOF_PASS", "MOAT_PROOF_PASS", "CLAIM_PROOF_MISSING"]
PROOFS = ["SPAN_PROOF_PASS", "MOAT_PROOF_PASS", "CLAIM_PROOF_MISSING"]


def first_value(document: Column, paths: Sequence[str]) -> Column:
    """the first path with a value, as text."""
    return F.coalesce(*[F.get_json_object(document, f"$.{p}") for p in paths])


class Firsts:
    """First values by path of one JSON column: paths within an object that a document hasn't got aren't looked for.

    Each look reads the whole text, and most paths stand in objects of a few forms; these are looked for once.
    """

    def __init__(self, column: str) -> None:
        self.column = column
        self.holders: dict[str, str] = {}

    def value(self, paths: Sequence[str]) -> Column:
        return F.coalesce(*[self._look(p) for p in paths])

    def _look(self, path: str) -> Column:
        found = F.get_json_object(self.column, f"$.{path}")
        above, _, _ = path.rpartition(".")
        return F.when(F.col(self._holder(above)), found) if above else found

    def _holder(self, path: str) -> str:
        if path not in self.holders:
            above, _, _ = path.rpartition(".")
            if above:
                self._holder(above)
            self.holders[path] = f"_{self.column}_{len(self.holders)}"
        return self.holders[path]

    def with_holders(self, df: DataFrame) -> DataFrame:
        """``df`` with a truth value for each object that paths lead through, the outer ones first."""
        for depth in range(max([p.count(".") for p in self.holders], default=-1) + 1):
            df = df.withColumns({name: self._look(p).isNotNull() for p, name in self.holders.items() if p.count(".") == depth})
        return df


def whole(text: Column) -> Column:
    """a whole number or null; truth values and fractions aren't numbers."""
    return F.when(F.trim(text).rlike(r"^[+-]?[0-9]+$"), F.trim(text).try_cast("long"))


def summed(text: Column) -> Column:
    """The sum of all whole numbers in a JSON value, whatever its depth; null for none.

    Keys go first, then texts; what is left of a number's form is a value.
    """
    plain = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"\s*:', ":"), r'"(?:[^"\\]|\\.)*"', '""')
    numbers = F.regexp_extract_all(plain, F.lit(r"(?<![0-9.eE+-])(-?[0-9]+)(?![0-9.eE])"), F.lit(1))
    return F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x.cast("long")))


def detector_status(verdict: Column) -> Column:
    """F19."""
    return F.when(verdict == "SPANNING", "ANY_SPAN_DETECTED").when(verdict == "MOAT", "ANY_SHELL_MOAT_DETECTED").otherwise("UNKNOWN_DETECTOR_STATUS")


def verdict_mode(verdict: Column) -> Column:
    """F19."""
    return F.when(verdict == "SPANNING", "ANY-SPAN").when(verdict == "MOAT", "ANY-SHELL-MOAT")


def _status(audit: Firsts, paths: tuple[str, ...], words: list[str]) -> Column:
    value = audit.value(paths)
    return F.when(value.isin(words), value)


def sweep_rows(profiles: DataFrame) -> DataFrame:
    """Normalised rows of profiles (path, profile, audit): JSON texts, the audit null if there is none."""
    p, a = Firsts("profile"), Firsts("audit")
    cols: dict[str, Column] = {}
    for name, paths in PATHS.items():
        value = p.value(paths)
        cols[name] = whole(value) if name in WHOLE else value.try_cast("double") if name in REAL else F.when(value.isin("true", "false"), value == "true") if name in TRUTH else value
    for name, ns in DISTRIBUTIONS.items():
        cols[name] = p.value([*(f"stats_v2.{n}" for n in ns), *(f"stats_v2.{g}.{n}" for n in ns for g in ("distributions", "histograms", "distribution"))])
    top = ("high_pressure_tiles", "high_pressure", "high_pressure_top_n")
    cols["high_pressure_tiles"] = p.value([*(f"stats_v2.{n}" for n in top), *(f"stats_v2.{g}.{n}" for n in top for g in ("top_n", "top_tiles", "ranked_tiles"))])
    cols["overflow_total"] = summed(p.value(["overflow_counters"]))
    cols["width"] = F.coalesce(whole(p.value(["radii.width", "width"])), cols["r_outer"] - cols["r_inner"])
    cols["claim_id"] = F.coalesce(p.value(["claim_id"]), F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1))
    post = _status(a, ("postflight_status", "status", "summary.status", "report.status"), POSTFLIGHT)
    proof = F.coalesce(F.when(a.value(["proof_status", "claim.proof_status", "proof.status"]).isin(PROOFS), a.value(["proof_status", "claim.proof_status", "proof.status"])), F.when(p.value(["proof_status"]).isin(PROOFS), p.value(["proof_status"])))
    cols["postflight_status"] = post
    cols["proof_status"] = F.coalesce(proof, F.when(post.isin(PROOFS), post), F.lit("CLAIM_PROOF_MISSING"))
    cols["run_contract_status"] = F.coalesce(_status(a, ("run_contract_status", "run_contract.status"), POSTFLIGHT), F.when(post == "REJECT", "REJECT").when(post.isNotNull(), "RUN_CONTRACT_PASS"))
    cols["tile_sample_audit_status"] = F.coalesce(_status(a, ("tile_sample_audit_status", "tile_sample_audit.status", "audit.status"), POSTFLIGHT), F.when(post == "TILE_SAMPLE_AUDIT_PASS", post))
    cols["verdict_mode"], cols["detector_status"] = verdict_mode(cols["verdict"]), detector_status(cols["verdict"])
    return a.with_holders(p.with_holders(profiles)).select(F.lit(1).alias("sweep_row_schema_version"), F.col("path").alias("source_profile"), *[cols[n].alias(n) for n in sorted(cols)])


def matrix_rows(rows: DataFrame, hardening: int = 36) -> DataFrame:
    """The matrix summary of sweep rows: statuses of each run, in words, sorted with missing values last."""
    word = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", "MISSING").when(F.col(c) == "MOAT_PROOF_PASS", "RESERVED_MOAT_PROOF_STATUS").otherwise(F.col(c))
    none = F.coalesce("bz_checked", "bz_clean", "bz_override_used").isNull() & F.col("bz_bad_norm_count").isNull()
    bz = F.when(none, "MISSING").when(F.col("bz_checked") & F.col("bz_clean") & ~F.col("bz_override_used") & (F.col("bz_bad_norm_count") == 0), "PASS").otherwise("FAIL")
    over = F.when(F.col("overflow_total").isNull() & F.col("emitted_overflow_bit_count").isNull(), "MISSING").when((F.coalesce("overflow_total", F.lit(0)) == 0) & (F.coalesce("emitted_overflow_bit_count", F.lit(0)) == 0), "PASS").otherwise("FAIL")
    stats = ["telemetry_level", "geo_i_tiles", "geo_o_tiles", "geo_i_ports", "geo_o_ports", *DISTRIBUTIONS, "high_pressure_tiles", "component_census", "sample_count"]
    present = F.coalesce(*[F.col(c).cast("string") for c in stats]).isNotNull()
    out = rows.select(
        "claim_id", "k_sq", "r_inner", "r_outer", "width", F.coalesce(F.col("k_sq") == hardening, F.lit(False)).alias("hardening"), word("verdict").alias("verdict"), word("postflight_status").alias("postflight_status"),
        word("run_contract_status").alias("run_contract_status"), word("tile_sample_audit_status").alias("tile_sample_audit_status"), bz.alias("bz_status"), over.alias("overflow_status"),
        F.when(present, "PRESENT").otherwise("MISSING").alias("stats_v2_status"), "geo_i_tiles", "geo_o_tiles", "active_tiles", "produced_tiles", "ingested_tiles",
    )
    return out.orderBy(*[F.asc_nulls_last(c) for c in ("k_sq", "r_inner", "width")])


def monotonicity(rows: DataFrame, hardening: int = 36) -> DataFrame:
    """(k_sq, r_inner, narrower_width, wider_width): a moat, then a span at a larger width."""
    from latticeflow.operators.windows import reversals

    found = reversals(rows.where(F.col("k_sq") == hardening), ["k_sq", "r_inner"], "width", "verdict", "MOAT", "SPANNING")
    return found.select("k_sq", "r_inner", F.col("narrower").alias("narrower_width"), F.col("width").alias("wider_width"))
