"""weftline: corpus preparation, sampling and scoring of conversational text as Spark plans."""
