"""tabloom.plans"""
