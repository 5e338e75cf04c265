"""Profile, clean and explore tables of any size on Spark."""
