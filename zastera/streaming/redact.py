"""Redaction of streams. A document in one row needs no state; a document that comes paragraph by paragraph does."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from zastera.functions.detectors import DETECTORS, SECRET_TYPES
from zastera.operators.common import on_path
from zastera.operators.redact import Config, Finder, redacted

_OUT = "doc_id string, para_no long, text string, new string"


def start(stream: DataFrame, folder: str, checkpoint: str, config: Config = Config()) -> StreamingQuery:
    """stream: doc_id, text, a whole document in each row. Rows of (doc_id, text, entities, warnings) are appended to `folder`; secrets are blotted out in the entities."""
    done = redacted(stream, config)
    if not config.show_secrets:
        done = blotted(done, config)
    return done.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def blotted(done: DataFrame, config: Config = Config()) -> DataFrame:
    """`redacted` rows whose entities hold secrets as the written map does."""
    secret = [*SECRET_TYPES, *(config.rename[t] for t in SECRET_TYPES if t in config.rename)]
    card = ["CARD", config.rename.get("CARD", "CARD")]

    def one(e):
        hide = e["type"].isin(*secret)
        blot = F.when(e["type"].isin(*card), F.concat(F.lit("***"), F.right(e["original"], F.lit(4)))).otherwise(F.lit("***"))
        return e.withField("original", F.when(hide, blot).otherwise(e["original"])).withField("variants", F.when(hide, F.array().cast("array<string>")).otherwise(e["variants"]))

    return done.withColumn("entities", F.transform("entities", one))


def paragraphs(stream: DataFrame, config: Config = Config()) -> DataFrame:
    """stream: doc_id, para_no, text, a paragraph in each row; gives doc_id, para_no, text, new (JSON of the entities first seen there).

    A document's labels are kept as state, so a value has the same tag in every paragraph, numbered in the order of
    arrival; within a batch that is the order of para_no. A person is one by its nominative; forms that only a later
    paragraph explains are not found in earlier ones.
    """

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen: dict[str, dict[str, int]] = json.loads(state.get[0]) if state.exists else {}
        finder = Finder(config, DETECTORS, None)
        rows = pd.concat(list(batches)).sort_values("para_no", kind="stable")
        out = []
        for para, text in zip(rows["para_no"], rows["text"], strict=True):
            hits, _, masks = finder.find([text or ""])[0]
            put, new = list(masks), []
            for h in hits:
                type_ = config.rename.get(h.type, h.type)
                own = seen.setdefault(type_, {})
                if h.original not in own:
                    own[h.original] = len(own) + 1
                    new.append({"type": type_, "label": f"[[{type_}_{own[h.original]}]]", "original": h.original})
                put.append((h.start, h.stop, f"[[{type_}_{own[h.original]}]]"))
            parts, end = [], 0
            for a, b, with_ in sorted(put):
                parts += [(text or "")[end:a], with_]
                end = b
            out.append((key[0], para, None if text is None else "".join([*parts, text[end:]]), json.dumps(new, ensure_ascii=False)))
        state.update((json.dumps(seen, ensure_ascii=False),))
        yield pd.DataFrame(out, columns=["doc_id", "para_no", "text", "new"])

    on_path(stream.sparkSession)
    rows = stream.selectExpr("CAST(doc_id AS STRING) AS doc_id", "CAST(para_no AS LONG) AS para_no", "text")
    return rows.groupBy("doc_id").applyInPandasWithState(work, _OUT, "seen string", "append", GroupStateTimeout.NoTimeout)

