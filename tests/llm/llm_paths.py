VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
