"""The whole analysis: files in, findings and one record per file out."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from riskweave.functions import constants as K
from riskweave.functions.columns import sanitise_name
from riskweave.operators import merge, scoring, summary
from riskweave.operators.gates import REASONS, content_reason, upload_reason
from riskweave.operators.rules import static_findings
from riskweave.operators.structure import all_sites, first_problems, method_snippets
from riskweave.plans.stage import staged

#: What is known about a file besides its text; its last site carries it.
ABOUT = ["file_name", "checksum_sha256", "file_size_bytes"]

#: External scores, or what makes them from the methods of the files.
Scores = DataFrame | Callable[[DataFrame], DataFrame] | None


def _raw(files: DataFrame) -> str:
    """The column with the file as it was received: bytes where there are any."""
    return "content" if "content" in files.columns else "src"


def record_id(run_id: str) -> Column:
    """One id per run and file."""
    return F.concat_ws("/", F.lit(run_id), F.col("file_id").cast("string"))


class Analysis:
    """Results of one run. Each part is built when it is first asked for.

    Three tables are stored, each once and only if something needs it: the sites of the
    files, the scored methods, and the merged findings. The sites are the one reader
    of the files; the last site of a file carries its name, size, checksum and the gate that
    turned it away, so records and rejects come from there.
    """

    def __init__(self, files: DataFrame, reject_reason: Column | None, scores: Scores, analysed_at: Column | None, run_id: str | None,
                 max_snippets: int | None, max_chars: int | None, in_buckets: bool) -> None:
        self.files, self.reject_reason, self.scores, self.run_id = files, reject_reason, scores, run_id or uuid.uuid4().hex
        self.analysed_at, self.max_snippets, self.max_chars = analysed_at, max_snippets, max_chars
        self.in_buckets, self._observed = in_buckets, Observation()

    @cached_property
    def everything(self) -> DataFrame:
        """Sites of all files; a rejected file is not cut into tokens and has its last site only."""
        raw = F.col(_raw(self.files)).cast("binary")
        described = [F.sha2(raw, 256).alias("checksum_sha256"), F.octet_length(raw).cast("int").alias("file_size_bytes")]
        if self.reject_reason is None:
            sites = all_sites(self.files.select("file_id", "src", "file_name", *described), ABOUT, observation=self._observed, in_buckets=self.in_buckets, apart=True)
            return staged(sites.withColumn("reject_reason", F.lit(None).cast("string")), "sites")
        judged = self.files.withColumn("reject_reason", self.reject_reason)
        taken = F.when(F.col("reject_reason").isNull(), F.col("src")).alias("src")
        counts = {reason: F.count(F.when(F.col("reject_reason") == reason, 1)) for reason in REASONS}
        files = judged.select("file_id", taken, "file_name", *described, "reject_reason")
        return staged(all_sites(files, [*ABOUT, "reject_reason"], counts, self._observed, self.in_buckets, apart=True), "sites")

    @cached_property
    def reject_counts(self) -> dict[str, int]:
        """Files per gate that turned them away, counted while the sites were written; files without id are not among them."""
        self.everything  # noqa: B018 - the counts come with it
        return {reason: n for reason, n in self._observed.get.items() if reason in REASONS and n}

    @property
    def _ends(self) -> DataFrame:
        return self.everything.where(F.col("kind") == "eof")

    @property
    def sites(self) -> DataFrame:
        return self.everything.where(~F.col("broken")).drop(*ABOUT, "reject_reason")

    @property
    def static(self) -> DataFrame:
        """Structural findings."""
        return static_findings(self.sites)

    @property
    def methods(self) -> DataFrame:
        return method_snippets(self.sites)

    @cached_property
    def scored(self) -> DataFrame:
        """Methods with their scores; signatures are tried once."""
        if self.scores is None:
            scored = scoring.scored_snippets(self.methods, self.max_snippets, self.max_chars)
        else:
            scores = self.scores(self.methods) if callable(self.scores) else self.scores
            scored = scoring.attach_scores(self.methods, scores, self.max_snippets, self.max_chars)
        return staged(scored, "scored")

    @cached_property
    def _merged(self) -> DataFrame:
        return staged(merge.merged_findings(self.static, self.scored), "findings")

    @property
    def _described(self) -> DataFrame:
        """(file_id, file_name, checksum_sha256, file_size_bytes) of the files whose structure holds."""
        return self._ends.where(F.col("reject_reason").isNull() & ~F.col("broken")).select(
            "file_id", "file_name", "checksum_sha256", "file_size_bytes")

    @property
    def _stamp(self) -> Column:
        return (F.lit(None) if self.analysed_at is None else self.analysed_at).cast("timestamp_ntz")

    @property
    def findings(self) -> DataFrame:
        names = self._described.select("file_id", "file_name")
        return self._merged.join(names, "file_id").withColumns(
            {"record_id": record_id(self.run_id), "run_id": F.lit(self.run_id), "created_at": self._stamp})

    @property
    def records(self) -> DataFrame:
        counts = self.sites.where(F.col("kind") == "method").groupBy("file_id").agg(F.count("*").cast("int").alias("methods_analysed"))
        records = summary.analysis_records(self._described, self._merged, self.scored, counts).withColumns(
            {"record_id": record_id(self.run_id), "run_id": F.lit(self.run_id)})
        return records if self.analysed_at is None else records.withColumn("analysed_at", self._stamp)

    @property
    def broken(self) -> DataFrame:
        """(file_id, line, reason) of files whose structure does not hold."""
        return first_problems(self.everything)

    @property
    def rejected(self) -> DataFrame:
        """(file_id, safe_name, reject_reason, line) of the files that are not in the records."""
        safe_name = sanitise_name(F.col("file_name")).alias("safe_name")
        names = self._ends.select("file_id", safe_name, "reject_reason", F.lit(None).cast("int").alias("line"))
        gate = names.where(F.col("reject_reason").isNotNull())
        broken = self.broken.join(names.select("file_id", "safe_name"), "file_id").select(
            "file_id", "safe_name", F.col("reason").alias("reject_reason"), "line")
        # a file without id can't be told from others, so it has no sites; its content is not read
        unknown = self.files.where("file_id is null").select(
            "file_id", safe_name, F.lit("NO_FILE_ID").alias("reject_reason"), F.lit(None).cast("int").alias("line"))
        return gate.unionByName(broken).unionByName(unknown)


def analyse(files: DataFrame, scores: Scores = None, analysed_at: Column | None = None, run_id: str | None = None,
            max_snippets: int | None = None, max_chars: int | None = None, in_buckets: bool = False) -> Analysis:
    """``files``: file_id, file_name, src.  ``scores``: optional external score table, or a scorer of the methods.

    Without ``scores`` the signatures score every snippet; an empty score table
    stands for a scorer that was not reachable.  ``analysed_at`` stamps records and
    findings, ``run_id`` tells runs of the same files apart (one is made up if none is given).
    All methods are scored, with their whole text, unless ``max_snippets`` per file or
    ``max_chars`` per snippet are given; records say how many were. ``in_buckets``: the files
    come from a table in buckets of their id (``sources.bucketed``) and are not moved.
    """
    return Analysis(files, None, scores, analysed_at, run_id, max_snippets, max_chars, in_buckets)


def analyse_uploads(files: DataFrame, scores: Scores = None, analysed_at: Column | None = None, run_id: str | None = None,
                    max_bytes: int = K.MAX_FILE_BYTES, max_snippets: int | None = None, max_chars: int | None = None,
                    in_buckets: bool = False) -> tuple[Analysis, DataFrame]:
    """Gates first: (analysis of the accepted files, all other files).

    Rejected files have ``reject_reason`` and, where their structure does not hold,
    the line of the first problem; every file is in the records or among them.
    """
    reason = F.coalesce(upload_reason(F.col("file_name"), F.col("size_bytes"), max_bytes), content_reason(F.col(_raw(files))))
    result = Analysis(files, reason, scores, analysed_at, run_id, max_snippets, max_chars, in_buckets)
    return result, result.rejected
