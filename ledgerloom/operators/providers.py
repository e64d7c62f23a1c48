"""Places where models plug in, with defaults that need none."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X
from .questions import DOC_WORDS, focuses_from_answer
from .retrieval import lexical_score, lexical_words, unit_vector


class IntentModel(Protocol):
    def intent(self, query: Column) -> Column: ...


class Embedder(Protocol):
    def embed(self, text: Column) -> Column: ...


class Scorer(Protocol):
    def score(self, query: Column, text: Column) -> Column: ...


class Generator(Protocol):
    def answer(self, query: Column, context: Column) -> Column: ...


class Completer(Protocol):
    """A model's answer to a prompt; implementations call their service from an Arrow-batched function and pace themselves."""

    def complete(self, prompt: Column) -> Column: ...


class Refiner(Protocol):
    """Focuses set right by a model that sees the question and what the rules found in it."""

    def refine(self, query: Column, focuses: Column) -> Column: ...


class FixedCompleter:
    """The same answer to every prompt, with its length for ``{n}``: stands in for a model in tests."""

    def __init__(self, answer: str) -> None:
        self.said = answer

    def complete(self, prompt: Column) -> Column:
        return F.replace(F.lit(self.said), F.lit("{n}"), F.length(prompt).cast("string"))


class RuleRefiner:
    """What the rules found, unchanged."""

    def refine(self, query: Column, focuses: Column) -> Column:
        return focuses


class ModelRefiner:
    """A completer's JSON read as focuses; the rules' own where the answer can't be read."""

    def __init__(self, completer: Completer, instruction: str = "Question: {query}\nFound: {focuses}") -> None:
        self.completer, self.instruction = completer, instruction

    def refine(self, query: Column, focuses: Column) -> Column:
        before, rest = self.instruction.split("{query}")
        middle, after = rest.split("{focuses}")
        prompt = F.concat(F.lit(before), F.coalesce(query, F.lit("")), F.lit(middle), F.coalesce(F.to_json(focuses), F.lit("[]")), F.lit(after))
        return focuses_from_answer(self.completer.complete(prompt), focuses)


class RuleIntent:
    """Prices only: market; documents only: search; both or neither: hybrid."""

    def intent(self, query: Column) -> Column:
        price = X.asks_price(query)
        docs = F.lower(query).rlike("|".join(w.lower() for w in DOC_WORDS))
        return F.when(price & ~docs, "MARKET_DATA_ONLY").when(docs & ~price, "DOCUMENT_SEARCH").otherwise("HYBRID")


class HashingEmbedder:
    """Words hashed to signed coordinates, scaled to length 1: a stand-in for a trained embedding, all in expressions."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed(self, text: Column) -> Column:
        words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0))
        at = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(self.dim)).alias("i"), (F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) * 2 - 1).alias("s")))
        # the hashed words are held, else each coordinate would hash them again
        raw = F.transform(F.array(at), lambda h: F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), lambda i: F.aggregate(h, F.lit(0.0), lambda a, x: a + F.when(x["i"] == i, x["s"]).otherwise(0))))
        return unit_vector(F.get(raw, 0))


class LexicalScorer:
    def features(self, text: Column) -> Column:
        """64-bit hashes of the distinct words: ``score`` is the share of the query's that the text has, so the search can score where it finds."""
        return F.transform(lexical_words(text), lambda w: F.xxhash64(w))

    def score(self, query: Column, text: Column) -> Column:
        return lexical_score(query, text)


class ContextAnswer:
    """The context itself, for pipelines without a generator."""

    def answer(self, query: Column, context: Column) -> Column:
        return X.without_citations(context)
