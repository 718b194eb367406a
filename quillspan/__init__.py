"""quillspan: point traces, interval tables and k-mers as DataFrame operators."""
