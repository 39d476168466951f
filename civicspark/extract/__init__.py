"""Records read out of documents: vote blocks, minutes, laid-out tables, disclosure lines, nested JSON."""
