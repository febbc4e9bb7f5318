"""One session's engine: configuration, models, tools, the chunk store; what the command line and the service start."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import DataFrame, SparkSession, functions as F

from .config import DEFAULT, SESSION, Config
from .functions import providers, tools
from .logs import split_logger
from .operators import agent, route
from .operators.nodes import configured
from .sources import markdown
from .sources.shared import exists, saved, shared_dir
from .sources.versioned import ChunkStore


def session(name: str = "ragframe", **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(name)
    for k, v in (SESSION | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


MESSAGES = "conv_id long, turn long, role string, text string"
SUMMARIES = "conv_id long, context_summary string, summarised_till long, asked long"


@dataclass
class Engine:
    """Models are looked up and probed before anything runs; turns are appended to tables of the application's shared folder."""

    spark: SparkSession
    path: str  # of the chunk store
    cfg: Config = DEFAULT
    ids: count = field(default_factory=count)

    def __post_init__(self) -> None:
        for name in (self.cfg.chat_model, self.cfg.embedding_model):
            providers.check_model_present(name)
        if self.cfg.chat_model != DEFAULT.chat_model:
            works, why = providers.check_model_works(providers.setup_llm(self.cfg.chat_model), self.cfg.probe_timeout, self.cfg.probe_tries)
            if not works:
                raise RuntimeError(f"chat model {self.cfg.chat_model!r}: {why}")
        self.tools = tools.register_tools([tools])
        self.nodes = configured(self.spark, self.cfg)
        self.store = ChunkStore(self.spark, self.path)
        self.log = split_logger("ragframe.engine")
        self._at = f"{shared_dir(self.spark)}/engine-{uuid.uuid4().hex}"

    def load(self, sources: str, again: bool = False) -> None:
        """Bring the files of the sources that are new or were edited into the store; all anew, if asked."""
        if again:
            self.store.drop(confirm=True)
        version = self.store.ingest(markdown.scan_stores(self.spark, sources), self.cfg)
        if version is None:
            self.log.info("nothing is new in %s", sources)
        else:
            self.log.info("%s is in the store as of version %d", sources, version)

    def chunks(self) -> DataFrame:
        heads = ["h1", "h2", "h3", "h4"]
        return self.store.chunks().select("store", F.xxhash64("store", "file_hash", "chunk_ix").alias("chunk_id"), *heads, "text", "embedding")

    def _table(self, name: str, schema: str) -> DataFrame | None:
        return self.spark.read.schema(schema).parquet(f"{self._at}/{name}") if exists(self.spark, f"{self._at}/{name}") else None

    @property
    def messages(self) -> DataFrame | None:
        return self._table("messages", MESSAGES)

    @property
    def summaries(self) -> DataFrame | None:
        told = self._table("summaries", SUMMARIES)
        return None if told is None else told.groupBy("conv_id").agg(F.max_by(F.struct("context_summary", "summarised_till"), "asked").alias("s")).select("conv_id", "s.*")

    def ask(self, query: str, conv_id: int = 0) -> str:
        """The reply to one question of a conversation, whose log and summary go on from turn to turn; a turn appends its own rows only."""
        qid = next(self.ids)
        asked = self.spark.createDataFrame([(qid, conv_id, query)], "qid long, conv_id long, query string")
        out = agent.converse(asked, self.chunks(), self.cfg, self.nodes, self.messages, self.summaries)
        new = saved(out.states.select("conv_id", "reply", "context_summary", "summarised_till"), "engine")
        out.added.select("conv_id", "turn", "role", "text").write.mode("append").parquet(f"{self._at}/messages")
        new.select("conv_id", "context_summary", "summarised_till", F.lit(qid).cast("long").alias("asked")).write.mode("append").parquet(f"{self._at}/summaries")
        return new.first()["reply"] or route.CLARIFY
