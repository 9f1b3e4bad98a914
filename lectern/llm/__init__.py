"""Training-data operators: licences, packing, sharding, near-duplicates, token counts, token files, chat, HTML, quality, decontamination."""
