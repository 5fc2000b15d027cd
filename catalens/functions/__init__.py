"""Pure column expressions; none of them needs a shuffle or leaves the JVM, except the stemmer."""
