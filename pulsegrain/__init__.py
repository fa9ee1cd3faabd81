"""Analytics on ordered sequences, as DataFrame operators: search, clocks, clustering, decoding, pairing, merging."""
