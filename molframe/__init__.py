"""molframe: molecular-structure analytics as Spark DataFrame transforms."""
