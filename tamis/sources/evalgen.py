"""A seeded evaluation corpus: facts, paraphrases, distractors, copies and junk, with queries and labels."""

from __future__ import annotations

import random
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

SERVICES = [f"{a} {b}" for a in ("Mail", "Backup", "Payroll", "Archive", "Calendar") for b in ("gateway", "console", "service", "portal")]
#: attribute, question, ways to state it, ways to say it otherwise, ways to talk about it without it.
ATTRIBUTES = [
    ("limit", "How large may a file in the {s} be?", "In the {s} a file may have up to {v} MB.", "Files beyond {v} MB are refused by the {s}.", ["The {s} has a limit on the size of files.", "Large files slow the {s} down; see its size settings."]),
    ("window", "When is the {s} under maintenance?", "Maintenance of the {s} begins at {v}:00 on Sundays.", "On Sundays the {s} pauses from {v}:00 for upkeep.", ["The {s} has a weekly maintenance window.", "Maintenance of the {s} is announced by mail."]),
    ("retention", "How long does the {s} keep records?", "The {s} keeps records for {v} days.", "After {v} days the {s} deletes its records.", ["Records of the {s} are deleted after a while.", "How the {s} keeps records is set by an administrator."]),
    ("price", "What does a seat of the {s} cost?", "A seat of the {s} costs {v} euros a month.", "For each user the {s} is billed at {v} euros monthly.", ["Prices of the {s} depend on the plan.", "Seats of the {s} are billed each month."]),
]
FILLERS = ["Changes are announced beforehand.", "The help desk answers further questions.", "Administrators may change this.", ""]
UNRELATED = ["A long walk along the coast takes four hours.", "Dough rests better in a cool place.", "Old maps show a bridge that is gone.", "Snow fell on the pass before noon.", "The choir sings on the first Friday."]
JUNK = ["ok", "done", "!!! ### $$$ %%% &&&", "thx", "???", "see above"]


@dataclass
class EvalSet:
    documents: list[tuple] = field(default_factory=list)  # doc_id, text, doc_class
    queries: list[tuple] = field(default_factory=list)  # query_id, query
    qrels: list[tuple] = field(default_factory=list)  # query_id, doc_id
    labels: list[tuple] = field(default_factory=list)  # doc_id, doc_class, topic_id, answer_bearing

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        return (
            spark.createDataFrame(self.documents, "doc_id string, text string, category string"),
            spark.createDataFrame(self.queries, "query_id string, query string"),
            spark.createDataFrame(self.qrels, "query_id string, doc_id string"),
            spark.createDataFrame(self.labels, "doc_id string, doc_class string, topic_id string, answer_bearing boolean"),
        )

    def write_csv(self, spark: SparkSession, folder: str) -> None:
        """documents.csv, ground_truth.csv and doc_labels.csv, each a folder of Spark's that its reader takes as one file."""
        docs, queries, qrels, labels = self.frames(spark)
        from pyspark.sql import functions as F

        truth = queries.join(qrels.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list("doc_id")), ",").alias("relevant_doc_ids")), "query_id", "left")
        flag = F.when(F.col("answer_bearing"), "True").otherwise("False")
        for df, name in ((docs.withColumnRenamed("doc_id", "id"), "documents"), (truth, "ground_truth"), (labels.withColumn("answer_bearing", flag), "doc_labels")):
            df.coalesce(1).write.mode("overwrite").csv(f"{folder}/{name}.csv", header=True, escape='"')


def perturb(text: str, rng: random.Random) -> str:
    """The same content with up to two slips of typing, half the time with a word before it."""
    slips = [(" may ", "  may "), (" the ", "  the "), (".", " ."), (" of ", "  of ")]
    rng.shuffle(slips)
    done = 0
    for old, new in slips:
        if done < 2 and old in text:
            text, done = text.replace(old, new, 1), done + 1
    return f"Note: {text}" if rng.random() < 0.5 else text


def generate(seed: int = 42, topics: int = 40, related: int = 2, irrelevant: int = 20, exact: int = 15, near: int = 15, junk: int = 12) -> EvalSet:
    """Each topic is an attribute of a service: a gold document, a paraphrase and distractors; every other one has a reference code with a query of its own."""
    rng, out = random.Random(seed), EvalSet()

    def add(text: str, kind: str, topic: str = "none") -> str:
        doc = f"doc_{len(out.documents) + 1:04d}"
        out.documents.append((doc, text, kind))
        out.labels.append((doc, kind, topic, kind in ("gold", "relevant", "exact_dup", "near_dup")))
        return doc

    pairs = [(s, a) for s in SERVICES for a in rng.sample(ATTRIBUTES, 2)]
    rng.shuffle(pairs)
    gold: list[tuple] = []
    for n, (service, (_, ask, state, other, around)) in enumerate(pairs[:topics]):
        topic, value = f"topic_{n:03d}", rng.randrange(2, 90)
        filled = lambda t: f"{t.format(s=service, v=value)} {rng.choice(FILLERS)}".strip()  # noqa: B023, E731
        code = f"{rng.choice('ABCDEFGH')}{rng.choice('KLMNPQRS')}-{rng.randrange(1000, 10000)}" if n % 2 == 0 else None
        text = filled(state) + (f" Its reference code is {code}." if code else "")
        gold.append((add(text, "gold", topic), text, topic, code))
        answers = [gold[-1][0], add(filled(other), "relevant", topic)]
        for t in around[:related]:
            add(filled(t), "related", topic)
        out.queries.append((f"q_{n:03d}", ask.format(s=service)))
        out.qrels += [(f"q_{n:03d}", d) for d in answers]
    copies: dict[str, list[str]] = {}
    for kind, count in (("exact_dup", exact), ("near_dup", near)):
        for doc, text, topic, _ in rng.sample(gold, min(count, len(gold))):
            copy = add(text if kind == "exact_dup" else perturb(text, rng), kind, topic)
            out.qrels.append((f"q_{topic[6:]}", copy))
            copies.setdefault(doc, []).append(copy)
    for n, (doc, _, _, code) in enumerate([g for g in gold if g[3]]):
        out.queries.append((f"qc_{n:03d}", f"Which entry has the reference code {code}?"))
        out.qrels += [(f"qc_{n:03d}", d) for d in [doc, *copies.get(doc, [])]]
    for n in range(irrelevant):
        add(f"{UNRELATED[n % len(UNRELATED)]} {rng.choice(UNRELATED)}", "irrelevant")
    for n in range(junk):
        add("Please check what you asked about. " * 8 if n % 3 == 2 else JUNK[n % len(JUNK)], "low_quality")
    return out
