"""Registered queries of word and byte-pair tokenizers and of batching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batching as G
from ..operators import bpe as B
from ..operators import vocabulary as V
from . import tables as T

#: Merges that the byte-pair queries learn: few, so that SQL can unroll them.
MERGES = 6
#: Word parts and word families asked for.
MORPHEMES = [("en", "suffix", "ing"), ("en", "suffix", "th"), ("en", "prefix", "re"), ("es", "suffix", "os"), ("es", "root", "as"), ("en", "root", "an"), ("en", "prefix", "un")]
FAMILIES = [("play", "play"), ("play", "plays"), ("play", "played"), ("play", "player"), ("nation", "nation"), ("nation", "nations"), ("nation", "national"), ("inform", "inform"), ("inform", "informed"), ("inform", "information")]


def _vocab(s, d, min_freq=5):
    return V.assign_ids(V.word_counts(V.tokens(T.lines(s, d))), min_freq)


def _ids(df, *keys):
    return df.select(*keys, F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


def _tokenizer(s, d):
    t = V.WordTokenizer()
    return t.train(T.lines(s, d))


def _word_decode(s, d):
    t = _tokenizer(s, d)
    return t.decode(t.encode(T.lines(s, d).drop("lang")), ["doc_id", "line_no"])


def _oov(s, d):
    coded = V.encode_tokens(V.tokens(T.lines(s, d)), _vocab(s, d))
    return coded.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("idx") == V.UNK).alias("n_unk"), F.round(100.0 * F.count_if(F.col("idx") == V.UNK) / F.count("*"), 6).alias("oov_rate"))


def _encoded_pairs(s, d, most=50):
    t = _tokenizer(s, d)
    pairs = T.line_pairs(s, d)
    sides = [t.encode(pairs.select("line_no", F.col(c).alias("text"))).select("line_no", G.framed(F.col("ids"), most).alias(f"{c}_ids")) for c in ("src", "tgt")]
    return sides[0].join(sides[1], "line_no")


def _padded(s, d):
    out = G.numbered_batches(_encoded_pairs(s, d), 100)
    return out.select("line_no", F.array_join(F.col("src_ids").cast("array<string>"), " ").alias("src"), F.array_join(F.col("tgt_ids").cast("array<string>"), " ").alias("tgt"), F.col("src_len").cast("long").alias("src_len"), F.col("tgt_len").cast("long").alias("tgt_len"))


def _shapes(s, d):
    out = G.numbered_batches(_encoded_pairs(s, d), 100)
    return out.groupBy("batch_id").agg(F.count("*").alias("n"), F.max(F.size("src_ids")).cast("long").alias("src_width"), F.max(F.size("tgt_ids")).cast("long").alias("tgt_width"), F.sum("src_len").alias("src_tokens"))


def _minibatches(s, d):
    """Full batches of 128 in order, as the data loader cuts them."""
    out = G.batches(_encoded_pairs(s, d), 128)
    return out.groupBy("batch_id").agg(F.count("*").alias("n"), F.max(F.size("src_ids")).cast("long").alias("src_width"), F.max(F.size("tgt_ids")).cast("long").alias("tgt_width"), F.min("line_no").alias("first"), F.sum("tgt_len").alias("tgt_tokens"))


def _trained(s, d):
    """The merges of the default vocabulary of 32,000 pieces; SQL cannot follow thousands of merges."""
    return B.BPETokenizer().train(T.lines(s, d)).merge_table(s)


def _shift(s, d):
    rows = _encoded_pairs(s, d)
    given, wanted = G.shifted(F.col("tgt_ids"))
    return rows.select("line_no", F.array_join(given.cast("array<string>"), " ").alias("given"), F.array_join(wanted.cast("array<string>"), " ").alias("wanted"))


def _learned(s, d):
    return B.BPETokenizer().train(T.lines(s, d), MERGES)


def _pieces(s, d):
    t = _learned(s, d)
    return t, B.words(T.lines(s, d).select("text")).select("word").distinct()


def _word_pieces(s, d):
    t, distinct = _pieces(s, d)
    return t.word_table(distinct).select("word", F.array_join("pieces", " ").alias("pieces"))


def _coded(s, d):
    t = _learned(s, d)
    return t, t.encode(T.lines(s, d))


def _roundtrip(s, d):
    t, coded = _coded(s, d)
    return t.decode(coded, ["doc_id", "line_no"])


def _bpe_coverage(s, d):
    _, coded = _coded(s, d)
    out = B.coverage(coded)
    return out.select("lang", *[F.round(c, 6).alias(c) for c in out.columns if c != "lang"])


def _families(s, d):
    t = _learned(s, d)
    rows = s.createDataFrame(FAMILIES, "family string, word string")
    return B.family_pieces(rows.join(t.word_table(rows.select("word").distinct()), "word").select("family", "word", "pieces"))


QUERIES = {
    "word_vocab": _vocab,
    "word_vocab_capped": lambda s, d: V.assign_ids(V.word_counts(V.tokens(T.lines(s, d))), 5, 1000),
    "word_vocab_coverage": lambda s, d: V.kept_share(V.word_counts(V.tokens(T.lines(s, d))), _vocab(s, d)).select(F.round("coverage", 6).alias("coverage")),
    "word_encode": lambda s, d: _ids(_tokenizer(s, d).encode(T.lines(s, d).drop("lang"), add_bos=True, add_eos=True), "doc_id", "line_no"),
    "word_decode": _word_decode,
    "word_oov_rate": _oov,
    "encode_truncate_pad": _padded,
    "batch_shapes": _shapes,
    "minibatches": _minibatches,
    "teacher_forcing_shift": _shift,
    "shared_words": lambda s, d: V.tokens(T.lines(s, d)).filter("lang = 'en'").select("token").intersect(V.tokens(T.lines(s, d)).filter("lang = 'fr'").select("token")),
    "bpe_initial_symbols": lambda s, d: B.initial_symbols(T.lines(s, d)).select("word", F.array_join("symbols", " ").alias("symbols"), "freq"),
    "bpe_symbol_counts": lambda s, d: B.symbol_counts(B.initial_symbols(T.lines(s, d))),
    "bpe_pair_freq": lambda s, d: B.pair_counts(B.initial_symbols(T.lines(s, d))),
    "bpe_merges_k": lambda s, d: _learned(s, d).merge_table(s),
    "bpe_train": _trained,
    "bpe_vocab": lambda s, d: _learned(s, d).vocabulary,
    "bpe_encode": _word_pieces,
    "bpe_decode": _roundtrip,
    "bpe_vocab_buckets": lambda s, d: B.vocabulary_buckets(_learned(s, d).vocabulary),
    "bpe_merge_lengths": lambda s, d: B.merge_lengths(_learned(s, d).merge_table(s)).select(*[F.round(c, 6).alias(c) for c in ("mean_len", "median_len")], "min_len", "max_len"),
    "bpe_coverage": _bpe_coverage,
    "bpe_utilization": lambda s, d: (lambda t, c: B.utilization(c, t.vocab_size).select("used", F.round("utilization", 6).alias("utilization")))(*_coded(s, d)),
    "bpe_morphemes": lambda s, d: B.morphemes(_learned(s, d).vocabulary, s.createDataFrame(MORPHEMES, "lang string, category string, morpheme string")),
    "bpe_family_common": _families,
    "bpe_trace": lambda s, d: B.trace(T.pairs(s, d).select("line_no", F.col("src").alias("text")), _learned(s, d)).select("line_no", F.col("pos").cast("long").alias("pos"), "word", F.array_join("symbols", " ").alias("symbols"), F.array_join("pieces", " ").alias("pieces")),
}

_V = f"({T.vocab_sql()})"
_CODED = f"select t.doc_id, t.lang, t.line_no, t.pos, coalesce(v.idx, 1) as idx, coalesce(v.token, '<UNK>') as word from ({T.TOKENS}) t left join {_V} v on t.token = v.token"


def _side(side: str) -> str:
    toks = f"select line_no, u.p as pos, coalesce(v.idx, 1) as idx from ({T.LINE_PAIRS}), unnest({T.plain_sql(side)}) with ordinality as u(w, p) left join {_V} v on v.token = u.w"
    whole = f"select p.line_no, [2] || coalesce(list(t.idx order by t.pos) filter (t.idx is not null), []) || [3] as ids from ({T.LINE_PAIRS}) p left join ({toks}) t on p.line_no = t.line_no group by p.line_no"
    return f"select line_no, case when len(ids) > 50 then ids[1:49] || ids[-1:] else ids end as ids from ({whole})"


_ENCODED = f"select a.line_no, a.ids as src_ids, b.ids as tgt_ids from ({_side('src')}) a join ({_side('tgt')}) b on a.line_no = b.line_no"
_BATCHED = f"select *, line_no // 100 as batch_id, max(len(src_ids)) over (partition by line_no // 100) as sw, max(len(tgt_ids)) over (partition by line_no // 100) as tw from ({_ENCODED})"
_WORDS = f"select word, count(*) as freq from (select unnest({T.words_sql('lower(text)')}) as word from {'(' + T.LINES + ')'}) group by word"
_SPELLED = f"select word, freq, ' ' || array_to_string(list_filter(string_split(word, ''), lambda c: c <> ''), '  ') || '  </w> ' as s from ({_WORDS})"


def _pairs_of(source: str) -> str:
    return f"select l[i] as a, l[i + 1] as b, freq from (select string_split(trim(s), '  ') as l, freq from {source}), lateral (select unnest(range(1, len(l))) as i)"


def _steps() -> str:
    """CTEs s0, m1, s1, ... : each merge takes the most frequent pair (ties by left, right) and rewrites the words."""
    parts = [f"s0 as materialized ({_SPELLED})"]
    for k in range(1, MERGES + 1):
        parts.append(f"m{k} as materialized (select a, b from ({_pairs_of(f's{k - 1}')}) group by a, b having sum(freq) >= 2 order by sum(freq) desc, a, b limit 1)")
        parts.append(f"s{k} as materialized (select word, freq, replace(s, ' ' || a || '  ' || b || ' ', ' ' || a || b || ' ') as s from s{k - 1}, m{k})")
    merges = " union all ".join(f"select cast({k - 1} as integer) as rank, a as \"left\", b as \"right\", a || b as merged from m{k}" for k in range(1, MERGES + 1))
    parts.append(f"merges as materialized ({merges})")
    parts.append(f"final as materialized (select word, freq, string_split(trim(s), '  ') as pieces from s{MERGES})")
    parts.append("symbols as materialized (select distinct unnest(string_split(trim(s), '  ')) as t from s0)")
    parts.append('tokens as materialized (select t from symbols union select "left" from merges union select "right" from merges union select merged from merges)')
    parts.append("vocab as materialized (select t as token, cast(row_number() over (order by t) + 3 as integer) as idx from tokens union all select unnest(['<PAD>', '<UNK>', '<BOS>', '<EOS>']), unnest([0, 1, 2, 3]))")
    return "with " + ", ".join(parts)


_S = _steps()
_TEXTS = f"select doc_id, line_no, lang, text, u.p as pos, u.w as word from ({T.LINES}), unnest({T.words_sql('lower(text)')}) with ordinality as u(w, p)"
_MORPHEME_SQL = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in MORPHEMES)
_FAMILY_SQL = ", ".join(f"('{a}', '{b}')" for a, b in FAMILIES)


def _fold(column: str) -> str:
    out = f"' ' || array_to_string(list_filter(string_split({column}, ''), lambda c: c <> ''), '  ') || '  </w> '"
    for k in range(1, MERGES + 1):
        out = f"replace({out}, (select ' ' || a || '  ' || b || ' ' from m{k}), (select ' ' || a || b || ' ' from m{k}))"
    return f"string_split(trim({out}), '  ')"


ORACLE_SQL = {
    "word_vocab": T.vocab_sql(),
    "word_vocab_capped": f"select * from {_V} where idx < 1000",
    "word_vocab_coverage": f"select round(100.0 * sum(case when freq >= 5 then freq else 0 end) / sum(freq), 6) as coverage from ({T.COUNTS})",
    "word_encode": f"select l.doc_id, l.line_no, array_to_string([2] || coalesce(list(c.idx order by c.pos) filter (c.idx is not null), []) || [3], ' ') as ids from ({T.LINES}) l left join ({_CODED}) c on l.doc_id = c.doc_id and l.line_no = c.line_no group by l.doc_id, l.line_no",
    "word_decode": f"select l.doc_id, l.line_no, coalesce(string_agg(c.word, ' ' order by c.pos) filter (c.idx >= 4), '') as text from ({T.LINES}) l left join ({_CODED}) c on l.doc_id = c.doc_id and l.line_no = c.line_no group by l.doc_id, l.line_no",
    "word_oov_rate": f"select lang, count(*) as n, count(*) filter (where idx = 1) as n_unk, round(100.0 * count(*) filter (where idx = 1) / count(*), 6) as oov_rate from ({_CODED}) group by lang",
    "encode_truncate_pad": f"select line_no, array_to_string(src_ids || list_resize([]::integer[], sw - len(src_ids), 0), ' ') as src, array_to_string(tgt_ids || list_resize([]::integer[], tw - len(tgt_ids), 0), ' ') as tgt, len(src_ids) as src_len, len(tgt_ids) as tgt_len from ({_BATCHED})",
    "batch_shapes": f"select cast(batch_id as bigint) as batch_id, count(*) as n, max(sw) as src_width, max(tw) as tgt_width, cast(sum(len(src_ids)) as bigint) as src_tokens from ({_BATCHED}) group by batch_id",
    "minibatches": f"select cast((p - 1) // 128 as bigint) as batch_id, count(*) as n, max(len(src_ids)) as src_width, max(len(tgt_ids)) as tgt_width, min(line_no) as first, cast(sum(len(tgt_ids)) as bigint) as tgt_tokens from (select *, row_number() over (order by line_no) as p from ({_ENCODED})) group by 1",
    "teacher_forcing_shift": f"select line_no, array_to_string(ids[1:len(ids) - 1], ' ') as given, array_to_string(ids[2:], ' ') as wanted from ({_side('tgt')})",
    "shared_words": f"select token from ({T.TOKENS}) where lang = 'en' intersect select token from ({T.TOKENS}) where lang = 'fr'",
    "bpe_initial_symbols": f"select word, array_to_string(list_filter(string_split(word, ''), lambda c: c <> ''), ' ') || ' </w>' as symbols, freq from ({_WORDS})",
    "bpe_symbol_counts": f"select symbol, cast(sum(freq) as bigint) as freq from (select unnest(string_split(trim(s), '  ')) as symbol, freq from ({_SPELLED})) group by symbol",
    "bpe_pair_freq": f"select a as \"left\", b as \"right\", cast(sum(freq) as bigint) as freq from ({_pairs_of('(' + _SPELLED + ')')}) group by a, b",
    "bpe_merges_k": f"{_S} select * from merges",
    "bpe_vocab": f"{_S} select token, idx from vocab",
    "bpe_encode": f"{_S} select word, array_to_string(pieces, ' ') as pieces from final",
    "bpe_decode": f"select doc_id, line_no, array_to_string({T.words_sql('lower(text)')}, ' ') as text from ({T.LINES})",
    "bpe_vocab_buckets": f"{_S} select case when idx < 4 then 'special' when length(token) = 1 then '1' when length(token) <= 4 then '2-4' when length(token) <= 8 then '5-8' when length(token) <= 12 then '9-12' else '13+' end as bucket, count(*) as n from vocab group by 1",
    "bpe_merge_lengths": f"{_S} select round(avg(length(merged)), 6) as mean_len, round(median(length(merged)), 6) as median_len, min(length(merged)) as min_len, max(length(merged)) as max_len from merges",
    "bpe_coverage": f"""{_S}, n as (select doc_id, line_no, sum(len(f.pieces)) as k from ({_TEXTS}) t join final f on t.word = f.word group by doc_id, line_no),
        l as (select lang, coalesce(k, 0) as k, length(text) as c from ({T.LINES}) t left join n on n.doc_id = t.doc_id and n.line_no = t.line_no where text <> '')
        select lang, round(avg(k), 6) as mean_tokens, round(avg(c), 6) as mean_chars, round(avg(k) / avg(c), 6) as fertility, cast(0 as double) as unk_rate, round(sum(c) / sum(k), 6) as chars_per_token from l group by lang""",
    "bpe_utilization": f"{_S}, u as (select count(distinct p) as used from (select unnest(pieces) as p from final)) select used, round(100.0 * used / (select 4 + count(*) + {MERGES} from symbols), 6) as utilization from u",
    "bpe_morphemes": f"{_S} select m.lang, m.category, m.morpheme, m.morpheme in (select regexp_replace(token, '</w>$', '') from vocab) as found from (values {_MORPHEME_SQL}) m(lang, category, morpheme)",
    "bpe_family_common": f"{_S}, w as (select family, word, {_fold('word')} as p from (values {_FAMILY_SQL}) f(family, word)), e as (select family, word, unnest(list_distinct(p)) as piece from w) select family, piece from e group by family, piece having count(distinct word) = (select count(*) from w where w.family = e.family)",
    "bpe_trace": f"{_S} select t.line_no, u.p - 1 as pos, u.w as word, array_to_string(list_filter(string_split(u.w, ''), lambda c: c <> ''), ' ') || ' </w>' as symbols, array_to_string({_fold('u.w')}, ' ') as pieces from ({T.PAIRS}) t, unnest({T.words_sql('lower(t.src)')}) with ordinality as u(w, p)",
}
