"""Where relations come from: the driver's tables bound to the code model, review and report files, source trees."""
