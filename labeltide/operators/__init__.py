"""DataFrame operators.

prepare   fill, dedup, union, project/rename, exact splits, counts, alignment
ordering  bucketed row numbers and hash keys
layout    size-checked broadcasts, input spreading, non-pushed filters
labels    label dictionary, encode/decode, argmax, repair, majority
encode    vocabulary, token ids, truncation, padding, batches
augment   drop / replace / generate augmentation
score     Arrow batch scorer, naive-Bayes weights, Spark ML pipeline
metrics   confusion, F1 family, MCC, loss, best epoch
"""
