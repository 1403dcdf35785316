"""Training-data operators: toxicity, packing, nearest neighbours, duplicate
detection, mixing, quality, chat formatting, personal data, language-model scores,
conversation tries and tokenizer alignment.  Nothing outside
this folder imports it except the optional registry in ``__spark_entry__``."""
