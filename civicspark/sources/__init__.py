"""Files that records come from: JSON, CSV, XML, archives, feeds, encoded bodies."""
