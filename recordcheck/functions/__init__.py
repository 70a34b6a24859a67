"""Value functions: Column expressions where Spark can express them, Arrow functions where it cannot."""
