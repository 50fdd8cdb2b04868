"""Training-data operators: packing, similarity joins, media chunks, token counts, toxicity, language models, WARC, licences, decontamination, pseudonyms."""
