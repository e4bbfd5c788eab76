"""Training-data operators over a `documents` table (doc_id, text, ...).

  near_dup     1  MinHash near-duplicates: dart-throwing weighted signatures, banded joins
  quality_net  2  quality classifier: byte-level convolutional network
  quality_gbt  3  quality rules: boosted trees over document statistics
  secrets      4  secret scans: character Markov models (DataFrame functions only)
  topk         5  exact top-k search: pivot-table elimination
  spans        6  substring dedup: sliding sentence spans
  ppm          7  LM scoring: prediction by partial matching
  packing      8  sum-of-squares online packing
  pieces       9  N-best SentencePiece segmentation and decoding
  toxicity     10 weighted lexicon over folded text
  suffix_match 11 benchmark decontamination by training suffix arrays
  filter_audit 12 filter interaction audit: min-plus removal ranks
  spelling     13 spelling variants: trie-node pair dictionary
  queries         the registered queries

Nothing outside this folder (and `corpus_pipeline.py`) imports it.

Common rules: operators read only the columns they name (further columns, of
any name, are ignored); a null text is an empty text unless stated otherwise;
an empty table gives an empty result with the same schema.
"""
